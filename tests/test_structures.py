"""Encodings, logs by byte ranges, runs with a limit, lines of many offsets, walks in trees, modes in SQL and the attempt ledger."""

import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracefold.functions import text
from tracefold.operators import coverage, mutate, tree, variants
from tracefold.sources import encodings, logs, runner
from tracefold.streaming import ingest

GERMAN = "Die Größe des Gerätes überrascht, schöne Grüße aus Köln.\n" * 3
JAPANESE = "これは日本語の文章です。コンパイラの診断を読みます。\n" * 3
CHINESE = "这是一个中文文件，用于测试编码检测。编译器报告错误。\n" * 3


@pytest.mark.parametrize(
    ("raw", "encoding"),
    [(b"", "ascii"), (b"int x;\n", "ascii"), (GERMAN.encode("utf-8"), "utf-8"), (GERMAN.encode("utf-8-sig"), "utf-8-sig"), (GERMAN.encode("utf-16"), "utf-16"), (GERMAN.encode("utf-16-le"), "utf-16-le"), (GERMAN.encode("utf-16-be"), "utf-16-be"), (b"\xfe\xff" + GERMAN.encode("utf-16-be"), "utf-16"), (GERMAN.encode("utf-32"), "utf-32"),
     (GERMAN.encode("latin-1"), "latin-1"), ("“Grüße” – 5 €".encode("cp1252"), "cp1252"), (JAPANESE.encode("shift_jis"), "shift_jis"), (CHINESE.encode("gb18030"), "gb18030"), (JAPANESE.encode("utf-8"), "utf-8"), (b"\x7fELF\x02\x01\x00\x00\x01", None), (bytes(range(256)), None), (b"caf\xe9 \x81", None)],
)
def test_detect(raw, encoding):
    assert encodings.detect(raw) == encoding
    assert encodings.decode_with(raw) == (encoding, raw.decode(encoding) if encoding else None)


@pytest.mark.parametrize("text", ["Çèen en vich de.", "Ößen ertzber eniechau ", "Una asas osci. Ñíco. Iejami", "und der. Öäver\nÖÄVER", "Éé"])
def test_a_capital_and_a_small_letter_are_no_hanzi(text):
    text.encode("latin-1").decode("gb18030")
    assert encodings.decode_with(text.encode("latin-1")) == ("latin-1", text)


@pytest.mark.parametrize("text", ["int 变量; // C语言 的 变量", "中", "// 级别A 请看"])
def test_short_hanzi_stay_hanzi(text):
    assert encodings.decode_with(text.encode("gb18030")) == ("gb18030", text)


def test_sources_in_many_encodings(spark, tmp_path):
    (tmp_path / "below").mkdir()
    made = {"a.c": ("latin-1", GERMAN), "b.cpp": ("utf-16", GERMAN), "below/c.cc": ("shift_jis", JAPANESE), "d.cxx": ("gb18030", CHINESE), "e.c": ("ascii", "int x;")}
    for name, (encoding, content) in made.items():
        (tmp_path / name).write_bytes(content.encode(encoding))
    (tmp_path / "f.c").write_bytes(b"\x00\x01\x02")
    (tmp_path / "g.txt").write_bytes(b"not a source")
    got = {r.file.removeprefix(f"file:{tmp_path}/"): r.text for r in logs.read_sources(spark, str(tmp_path)).collect()}
    assert got == {name: content for name, (_, content) in made.items()}
    assert logs.skipped_sources(spark, str(tmp_path)) == 1


# ---- logs by byte ranges ----


@pytest.mark.parametrize("cut", [1, 7, 23, 64, 150, 10**6])
def test_attempts_in_blocks_equal_attempts(spark, tmp_path, cut):
    head = lambda i, t: f"2024-11-18 10:00:0{i},{i:03} - INFO - {t}"
    files = {"a.log": ["before any head", "more", head(1, "one"), head(2, "two"), "second line", "", "2024-11-18 not a head", head(3, "")], "b.log": [head(4, "only")], "c.log": ["no head at all"], "d.log": [head(5, "x"), *(f"line {i} é" for i in range(30)), head(6, "y")]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = logs.read_attempts_in_blocks(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = spark.createDataFrame([(n, i, v) for n, lines in files.items() for i, v in enumerate(lines)], "file string, pos int, value string")
    want = sorted((r.file, r.time, r.level, r.message) for r in logs.read_attempts(whole).collect())
    assert sorted((r.file.rpartition("/")[2], r.time, r.level, r.message) for r in rows) == want
    in_order = sorted(rows, key=lambda r: (r.file, r.block, r.place))
    assert [r.time for r in in_order if r.file.endswith("a.log")] == [f"2024-11-18 10:00:0{i},{i:03}" for i in (1, 2, 3)]


# ---- runs ----


def test_a_runner_that_never_returns_is_killed(spark):
    def compiler(c):
        if c[0] == "sleep":
            time.sleep(10_000)
        if c[0] == "die":
            import os

            os._exit(3)
        if c[0] == "raise":
            raise ValueError("what")
        return (1, "bad") if c[0] == "bad" else (0, "")

    rows = spark.createDataFrame([([c],) for c in ("ok", "sleep", "bad", "die", "sleep", "raise", "ok")], "command array<string>").coalesce(1)
    began = time.time()
    got = [(r.command[0], r.status, r.message) for r in runner.run_variants(rows, compiler, limit=0.5).collect()]
    assert got == [("ok", "SUCCESS", ""), ("sleep", "TIMEOUT", ""), ("bad", "ERROR", "bad"), ("die", "ERROR", "the runner ended"), ("sleep", "TIMEOUT", ""), ("raise", "ERROR", "ValueError: what"), ("ok", "SUCCESS", "")]
    assert time.time() - began < 60


# ---- lines ----


def test_lines_equal_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab\\\n\n") for _ in range(rng.randrange(25)))
        lines = text.Lines(t)
        for offset in range(len(t) + 1):
            assert lines.number(offset) == t.count("\n", 0, offset) + 1
            rest = re.match(r"(?:[^\n]*\\\n)*[^\n]*", t[offset:]).group()  # as the column expression has it
            assert lines.line(offset) == t[t.rfind("\n", 0, offset) + 1 : offset] + rest


def test_annotations_take_time_in_proportion():
    line = "x; // expected-error@+1{{bad}}\n"
    found = lambda n: [text.Lines(line * n), list(text._ANNOTATION.finditer(line * n))]
    began = time.process_time()
    lines, hits = found(100_000)
    assert [lines.number(m.start()) for m in hits] == list(range(1, 100_001)) and time.process_time() - began < 5


def test_pairs_are_cut_from_the_line_alone():
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice("(){}x\\\n") for _ in range(rng.randrange(30)))
        for s, e in mutate.bracket_pairs(t, mutate.PAIRS):
            assert mutate.without_pair(t, s, e) == mutate.line_at(t[:s] + t[s + 1 : e] + t[e + 1 :], s)


# ---- trees ----


def test_owner_of_a_parenthesis_equals_a_walk(spark):
    rng = random.Random(8)
    kinds = ["CALL_EXPR", "IF_STMT", "UNEXPOSED_EXPR", "DECL_REF_EXPR"]
    trees, places = {}, []

    def grow(tree_id, path, depth):
        a, b = sorted((rng.randrange(12), rng.randrange(12)))
        l1, l2 = sorted((rng.randrange(1, 4), rng.randrange(1, 4)))
        trees.setdefault(tree_id, {})[tuple(path)] = (rng.choice(kinds), l1, l2, a, b)
        for i in range(rng.randrange(4) if depth else 0):
            grow(tree_id, [*path, i], depth - 1)

    for t in range(12):
        grow(t, [0], 3)
        places += [(t, line, col, "(") for line in (1, 2, 3) for col in range(0, 12, 2)]

    def walk(nodes, line, col):
        holds = lambda n: n[1] <= line <= n[2] and n[3] <= col <= n[4]
        at, way = (0,), []
        while at in nodes and holds(nodes[at]):
            way.append(nodes[at][0])
            at = next((p for p in sorted(nodes) if len(p) == len(at) + 1 and p[: len(at)] == at and holds(nodes[p])), None)
        return next((k for k in reversed(way) if k not in tree.NO_OWNER), None)

    nodes = spark.createDataFrame([(t, list(p), *n) for t, ns in trees.items() for p, n in ns.items()], "tree_id int, path array<int>, kind string, line_start int, line_end int, col_start int, col_end int")
    got = tree.parenthesis_owner(nodes, spark.createDataFrame(places, "tree_id int, line int, col int, symbol string")).collect()
    want = sorted((t, line, col, walk(trees[t], line, col) or "") for t, line, col, _ in places)
    assert sorted((r.tree_id, r.line, r.col, r.kind or "") for r in got) == want and len({w[3] for w in want}) == 3


# ---- modes ----


def test_modes_by_name_in_sql(spark):
    variants.register(spark, {"shout": lambda t, seed: iter([("shout", seed, t, t.upper())])})
    docs = spark.createDataFrame([(1, "a:::b [x, &y] (z)"), (2, ""), (3, None)], "doc_id long, text string")
    by = lambda mode: sorted((r.doc_id, r.mode, r.modified) for r in spark.sql("SELECT d.doc_id, v.* FROM {d} d, LATERAL variants(d.text, '" + mode + "', 3) v", d=docs).collect())
    for mode in ("replace_all", "remove_single", "remove_pair", "remove_parentheses", "lambda_captures"):
        assert by(mode) == sorted((r.id, r.mode, r.modified) for r in mutate.variants(docs, mode).collect()), mode
    assert by("replace_colon_with_semicolon")[0] == (1, "replace_colon_with_semicolon", "a::;b [x, &y] (z)")
    assert (1, "shout", "A:::B [X, &Y] (Z)") in by("shout")
    ((_, _, shuffled),) = [x for x in by("argsreorder") if x[0] == 1]
    assert sorted(shuffled.split()) == sorted("a:::b [x, &y] (z)".split())
    with pytest.raises(Exception, match="nothing"):
        by("nothing")
    kept = [m for _, _, _, m in variants.MODES["argsremove"]("-o x -Iy -c -W -g -O2", 5)]
    assert {"-o", "-Iy", "-c"} <= set(kept[0].split()) and kept != ["-o x -Iy -c -W -g -O2"]
    made = variants.with_nodes("int a;\nint b;", [4, 11, 11])
    assert list(variants.MODES["add_asterisk_to_variables"](made, 0)) == [("add_asterisk_to_variables", 4, "int a;", "int *a;"), ("add_asterisk_to_variables", 11, "int b;", "int *b;")]


def test_argument_modes_of_the_dispatch(spark):
    docs = spark.createDataFrame([(5, "-o x -W -g -c"), (6, ""), (7, None)], "doc_id long, text string")
    for mode in ("argsreorder", "argsremove"):
        got = {r.id: r.modified for r in mutate.variants(docs, mode).collect()}
        assert set(got) == {5, 6} and set(got[5].split()) <= set("-o x -W -g -c".split()) and got[6] == ""


# ---- ledger of attempts ----


def test_attempt_stream_equals_batch_over_shuffled_parts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, p, rng.random() < 0.2, None if rng.random() < 0.1 else rng.random() < 0.3) for k in range(25) for p in range(rng.randrange(1, 7))]
    schema = "key long, place long, small boolean, large boolean"
    want = sorted(map(str, coverage.attempts(spark.createDataFrame(rows, schema), "key", ["place"], F.col("small"), F.col("large")).collect()))
    rng.shuffle(rows)
    spark.conf.set(*ingest.ROCKSDB)
    try:
        for part in range(3):
            spark.createDataFrame(rows[part::3], schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = ingest.stream_log(spark, str(tmp_path / "in"), schema, "parquet")
            ingest.collect_updates(ingest.attempts(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.unset(ingest.ROCKSDB[0])
    got = ingest.latest(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(map(str, got.select("key", "n_small", "n_large", "solved_by", "solved_at").collect())) == want


def test_attempt_stream_calls_python_per_group_of_keys(spark, tmp_path, monkeypatch):
    """Named keys, the null one and null places in two groups; long keys beyond 2^53 beside a null stay exact."""
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counted(ingest.AttemptLedger):
        def handleInputRows(self, key, rows, timerValues):
            (calls / f"{key[0]}-{time.time_ns()}").touch()
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(ingest, "AttemptLedger", Counted)
    rows = [(None if k == 0 else 2**60 + k, None if p == 2 else p, p == 3, k % 2 == 0 and p == 1) for k in range(200) for p in range(5)]
    schema = "key long, place long, small boolean, large boolean"
    spark.conf.set(*ingest.ROCKSDB)
    try:
        for kind in ("long", "string"):
            given = spark.createDataFrame(rows, schema).withColumn("key", F.col("key").cast(kind))
            given.write.parquet(str(tmp_path / kind / "in"))
            stream = ingest.stream_log(spark, str(tmp_path / kind / "in"), schema.replace("key long", f"key {kind}"), "parquet")
            ingest.collect_updates(ingest.attempts(stream, kind, buckets=2), str(tmp_path / kind / "out"), str(tmp_path / kind / "state"))
            want = sorted(map(str, coverage.attempts(given, "key", ["place"], F.col("small"), F.col("large")).collect()))
            got = ingest.latest(spark.read.parquet(str(tmp_path / kind / "out"))).select("key", "n_small", "n_large", "solved_by", "solved_at")
            assert sorted(map(str, got.collect())) == want
    finally:
        spark.conf.unset(ingest.ROCKSDB[0])
    assert len(list(calls.iterdir())) == 6


LINES = "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double, l_discount double"


@pytest.mark.parametrize("name", ["attempts_until_success", "stream_attempts"])
def test_attempts_on_one_line_do_not_hang_on_the_order_of_rows(spark, tmp_path, name):
    """Lines that the order of the SQL leaves open: at the first place, before and behind the last one that is tried."""
    from tracefold.plans.registry import QUERIES

    rows = [(1, 1, 1, 1.0, 0.0), (1, 1, 1, 50.0, 0.0), (2, 1, 1, 1.0, 0.1), (2, 1, 1, 50.0, 0.0)]
    rows += [(3, 1, 1, 1.0, 0.0), (3, 1, 2, 1.0, 0.0), (3, 1, 3, 50.0, 0.0), (3, 1, 3, 1.0, 0.0), (4, 1, 1, 1.0, 0.0), (4, 1, 2, 1.0, 0.1), (4, 1, 2, 1.0, 0.0)]
    for i, given in enumerate((rows, rows[::-1])):
        spark.createDataFrame(given, LINES).coalesce(1).write.parquet(str(tmp_path / str(i) / "lineitem.parquet"))
        got = QUERIES[name](spark, str(tmp_path / str(i))).select("l_partkey", "n_small", "n_large", "solved_by", "solved_at").collect()
        assert sorted(map(tuple, got)) == [(1, 2, 1, "small", 2), (2, 1, 1, "large", 1), (3, 3, 3, None, None), (4, 3, 3, "large", 3)]


@pytest.mark.parametrize("name", ["attempts_until_success", "stream_attempts", "top3_per_key"])
def test_places_without_a_number_are_last_as_in_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from tracefold.plans.registry import QUERIES, SQL

    rng = random.Random(4)
    rows = [(None if k == 0 else k, o, n, rng.choice([None, 1.0, 1.0, float("nan")]), rng.choice([None, 0.0, 0.0, 0.1])) for k in range(60) for o in (None, 1, 2) for n in (None, 1, 2) if rng.random() < 0.4]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_attempt_stream_forgets_idle_keys(spark, tmp_path):
    schema = "key long, place long, small boolean, large boolean, came timestamp"
    hour = lambda h: datetime(2024, 1, 1, h)
    spark.conf.set(*ingest.ROCKSDB)
    try:
        for row in [(1, 1, False, False, hour(0)), (3, 1, False, False, hour(10)), (1, 2, False, True, hour(11)), (3, 2, True, False, hour(11))]:
            spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = ingest.stream_log(spark, str(tmp_path / "in"), schema, "parquet")
            ingest.collect_updates(ingest.attempts(stream, time="came", delay="1 second", idle_ms=7_200_000), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.unset(ingest.ROCKSDB[0])
    got = {r.key: (r.n_small, r.solved_by) for r in ingest.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {1: (1, "large"), 3: (2, "small")}  # what key 1 tried was forgotten before it came again


# ---- variants and trees ----


def test_kinds_at_equal_the_join(spark):
    rng = random.Random(11)
    nodes, places = [], []
    for t in range(20):
        for _ in range(rng.randrange(0, 12)):
            a, b = sorted((rng.randrange(40), rng.randrange(40)))
            nodes.append((t, [0] * rng.randrange(1, 4), rng.choice("ABCD"), a, b))
        places += [(t, rng.randrange(40)) for _ in range(15)]
    n = spark.createDataFrame(nodes, "tree_id long, path array<int>, kind string, start long, end long")
    p = spark.createDataFrame(places, "tree_id long, offset long")
    want = {(r.tree_id, r.offset): r.kind for r in tree.node_at(n, p, 8).collect()}
    got = tree.kinds_at(n, p).collect()
    assert {(r.tree_id, r.offset): r.kind for r in got} == {k: want.get(k) for k in places} and len(got) == len(set(places))


def test_changes_of_variants(spark):
    schema = "tree_id long, {0}path array<int>, kind string, spelling string, type string, location string, children int"
    node = lambda path, kind, spelling, at, n: (path, kind, spelling, "int", at, n)
    before = [node([], "UNIT", "a.c", "a.c:1:1", 1), node([0], "VAR_DECL", "x", "a.c:1:5", 1), node([0, 0], "LITERAL", "", "a.c:1:9", 0)]
    after = [node([], "UNIT", "modified1_a.c", "modified1_a.c:1:1", 2), node([0], "FIELD_DECL", "y", "modified1_a.c:1:5", 0), node([1], "NULL_STMT", "", "modified1_a.c:1:7", 0)]
    nodes = spark.createDataFrame([(1, *n) for n in before], schema.format(""))
    modified = spark.createDataFrame([(1, 3, *n) for n in after] + [(1, 8, *n) for n in before], schema.format("position long, "))
    docs = spark.createDataFrame([(1, "int: x :: 5")], "doc_id long, text string")
    found = variants.placed(docs, "replace_colon_with_semicolon")
    got = {r.position: r for r in tree.changes_of_variants(found, nodes, modified).collect()}
    assert sorted(got) == [3, 7, 8] and got[7].ast_changes is None and got[8].ast_changes == []
    assert (got[3].original_line, got[3].modified_line) == ("int: x :: 5", "int; x :: 5")
    assert [tuple(c) for c in got[3].ast_changes] == [
        ("structure_change", "UNIT children count changed from 1 to 2"), ("node_changed", "Node kind changed from 'VAR_DECL' to 'FIELD_DECL'"), ("name_changed", "Node spelling changed from 'x' to 'y'"),
        ("structure_change", "VAR_DECL children count changed from 1 to 0"), ("node_removed", "LITERAL '' removed from a.c:1:9"), ("node_added", "New NULL_STMT '' added at modified1_a.c:1:7"),
    ]


def test_parentheses_of_other_files_are_not_looked_up(spark):
    docs = spark.createDataFrame([(1, "for (x) (y)")], "doc_id long, text string")
    schema = "tree_id long, path array<int>, kind string, start long, end long, file string, main string"
    loop = lambda file: spark.createDataFrame([(1, [0], "FOR_STMT", 0, 6, file, "a.c")], schema)
    found = lambda nodes: sorted((r.start, r.node_kind) for r in mutate.remove_parentheses(docs, "doc_id", "text", nodes).collect())
    assert found(loop("a.c")) == [(8, None)] and found(loop("b.h")) == [(4, None), (8, None)]


def test_run_of_a_call():
    from tracefold.functions import commands

    environment = {"FUZZ_MODE": "remove_pair", "REMOVE_LEVEL": "3"}
    assert commands.run_of(["/x/wrapper++", "-c", "a.cpp"], environment) == (["clang++", "-c", "a.cpp"], ["remove_pair"], 3)
    assert commands.run_of(["wrapper", "a.c"], {}) == (["clang", "a.c"], [], 1)
    assert commands.run_of(["/usr/bin/cc", "a.c"], environment) == (["/usr/bin/cc", "a.c"], [], 1)


def test_lines_leave_python_as_numbers():
    """What Python gives back does not grow with the length of lines; nulls stay null."""
    import pyarrow as pa

    texts = pa.array(["é" * 1_000_000, None, "a\\\nb\nc", ""])
    spans = text.spans_of(texts, pa.array([list(range(0, 1_000_000, 1000)), [1], [0, 4, 5], []]))
    assert spans.nbytes < 100_000 and spans[0][0].as_py() == {"number": 1, "start": 0, "size": 1_000_000}
    assert spans[1].as_py() is None and spans[3].as_py() == []
    assert [tuple(s.values()) for s in spans[2].as_py()] == [(1, 0, 4), (2, 3, 1), (3, 5, 1)]


def test_annotations_hold_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["x\n" * 100_000 + "// expected-error {{a}} expected-error{{b}}\n// expected-error {{c}}", None, ""] * 40)
    tracemalloc.start()
    try:
        got = text.annotations_of(texts).to_pylist()
        assert tracemalloc.get_traced_memory()[1] < 2_000_000
    finally:
        tracemalloc.stop()
    assert got[1] is None and got[2] == [] and [(x["content"], x["line"]) for x in got[0]] == [("a", 100_001), ("b", 100_001), ("c", 100_002)]


def test_kinds_of_variants_make_each_variant_once(spark, tmp_path):
    """Variants with their lines pass the sweep: what makes them runs once, and rows without a text or a place keep a null kind."""

    def made(batches):
        for b in batches:
            (tmp_path / f"{time.time_ns()}").touch()
            yield b

    schema = "id long, mode string, at long, line string, modified string"
    rows = [(1, "m", 2, "abc", "ab"), (1, "n", 2, "abc", "bc"), (1, "m", None, "x", "y"), (None, "m", 1, "x", None), (2, "m", 0, "z", "")]
    found = spark.createDataFrame(rows, schema).coalesce(1).mapInPandas(made, schema)
    nodes = spark.createDataFrame([(1, [0], "A", 0, 9), (1, [0, 1], "B", 2, 3), (None, [0], "C", 0, 9)], "tree_id int, path array<int>, kind string, start int, end int")
    got = variants.with_kinds(found, nodes)
    assert got.columns == ["id", "at", "mode", "line", "modified", "node_kind"]
    assert sorted((str(r.id), str(r["at"]), r.mode, r.modified, r.node_kind) for r in got.collect()) == [("1", "2", "m", "ab", "B"), ("1", "2", "n", "bc", "B"), ("1", "None", "m", "y", None), ("2", "0", "m", "", None), ("None", "1", "m", None, None)]
    assert len(list(tmp_path.iterdir())) == 1
