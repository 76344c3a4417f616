"""Readers, writers, column functions and the seam for runs that no registered query covers."""

import json

import pytest
from pyspark.sql import functions as F

from tracefold.functions import commands, text
from tracefold.operators import coverage, mutate, tree
from tracefold.plans import inputs
from tracefold.sources import definitions, logs, runner
from tracefold.streaming import ingest


def values(spark, column, *rows, schema="t string"):
    return [r.x for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column.alias("x")).collect()]


def test_readers(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"message": "m", "status": "ERROR"}\n{"message": "n", "status": "SUCCESS"}\n')
    bad.write_text('{"message": "m"}\nbroken\n')
    assert [r.message for r in logs.read_strict(spark, str(good), logs.SOURCE_RUN).collect()] == ["m", "n"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        logs.read_strict(spark, str(bad), logs.SOURCE_RUN).collect()
    (tmp_path / "dir").mkdir()
    for k in range(2):
        (tmp_path / "dir" / f"{k}.json").write_text(json.dumps({"message": str(k)}))
    (tmp_path / "dir" / "x.txt").write_text('{"message": "no"}')
    assert sorted(r.message for r in logs.read_folder(spark, str(tmp_path / "dir"), logs.AGENT_RUN).collect()) == ["0", "1"]
    tree_log = spark.createDataFrame([("e",)], "error_message string")
    assert sorted(r.message for r in logs.messages(logs.read_strict(spark, str(good), logs.SOURCE_RUN), tree_log).collect()) == ["e", "m", "n"]
    lines = spark.createDataFrame([("Diag ID: 7 Located at: /a/b.c:12",), ("other",)], "value string")
    assert [tuple(r) for r in logs.read_locations(lines).collect()] == [(7, "/a/b.c", 12)]
    flags = spark.createDataFrame([("  warn_x [-Wx]",), ("  warn_y",), ("Head:",)], "value string")
    assert sorted((r["name"], r.flag) for r in logs.read_flags(flags).collect()) == [("warn_x", "-Wx"), ("warn_y", None)]
    assert sorted(r.path.rpartition("/")[2] for r in logs.list_files(spark, str(tmp_path)).collect()) == ["0.json", "1.json", "a.jsonl", "b.jsonl", "x.txt"]
    assert logs.count_lines(spark, str(good)) == 2 and logs.count_lines(spark, str(tmp_path / "none")).startswith("File not found")
    (tmp_path / "td" / "below").mkdir(parents=True)
    (tmp_path / "td" / "a.td").write_text('def err_a : Error<"a">;')
    (tmp_path / "td" / "below" / "b.td").write_text('def err_b : Error<"b">;')
    names = lambda deep: sorted(r["name"] for r in definitions.definition_names(definitions.scan_definitions(spark, str(tmp_path / "td"), deep)).collect())
    assert names(False) == ["err_a"] and names(True) == ["err_a", "err_b"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "err_a")], "id long, name string")
    logs.append_jsonl(rows, str(tmp_path / "j"))
    logs.append_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    logs.overwrite_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    logs.write_lines(rows, str(tmp_path / "l"), "name")
    logs.write_id_report(rows, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text([str(tmp_path / "l"), str(tmp_path / "r")]).orderBy("value").collect()] == ["Diag ID: 1: err_a", "err_a"]


def test_text_functions(spark):
    assert values(spark, text.code_deformat(F.col("t"), True), "`x`", "``y``", "```cpp\nz```") == ["x", "``y``", "\nz"]
    assert values(spark, text.escape(F.col("t"), "special"), "a.b*c|d") == ["a\\.b*c|d"]
    assert values(spark, text.escape(F.col("t"), "literal"), "a*|") == ["a\\*\\|"]
    assert values(spark, text.kind_name(F.col("t")), "CursorKind.VAR_DECL") == ["VAR_DECL"]
    assert values(spark, text.stem_name(F.col("t")), "/x/err_a.cpp", "err_b.c") == ["err_a", "err_b"]
    assert values(spark, text.modified_name(F.col("t")), "/x.d/a.cpp") == ["/x.d/a_modified.cpp"]
    got = values(spark, text.expected_annotations(F.col("t")), "a\n// expected-error\n{{ b }} expected-error@+2 {{c\nd}} expected-error{{e}}", "none", None)
    assert [[tuple(x)[1:] for x in g or []] for g in got] == [[("b", 2), ("c\nd", 3), ("e", 4)], [], []]
    assert values(spark, text.run_lines(F.col("t")), "// RUN: 1\n x // RUN: no\n" + "// RUN: 2\n" * 6)[0] == ["// RUN: 1"] + ["// RUN: 2"] * 4
    scope = values(spark, text.pragma_scope(F.col("t"), F.lit(1)), "#pragma x\n a\n b;\nc;", "#pragma y", "int a;")
    assert [s and (s["lines"], s["start"], s["end"]) for s in scope] == [(["#pragma x", "a", "b;"], 1, 3), (["#pragma y"], 1, 1), None]
    report = values(spark, text.annotation_report(F.lit("f"), F.lit(3), F.lit("g"), F.lit("h")), "x")[0]
    assert report.split("\n") == ["File: f", "Line: 3", "Full Error: g", "Error Content: h", "-" * 80]


def test_command_functions(spark):
    one = lambda c, argv: values(spark, c, (argv,), schema="t array<string>")[0]
    assert one(commands.substitute(F.col("t"), F.lit("a.c"), F.lit("b.c")), ["cc", "a.c", "a.c"]) == ["cc", "b.c", "a.c"]
    made = F.struct(F.lit("clang").alias("compiler"), F.array(F.lit("a.c")).alias("source_file"), F.col("t").alias("other_params"))
    assert one(commands.assemble(made), ["-o x", "-c"]) == ["clang", "a.c", "-o", "x", "-c"]
    assert one(commands.cl_sweep(F.col("t")), ["cc", "-fopenmp-version=50"])[-1] == ["cc", "-cl-std=clc++3.0"]
    assert commands.modes_of_environment({"FUZZ_MODE": "agent, remove_pair&nothing", "REMOVE_LEVEL": "2"}) == (["agent", "remove_pair"], 2)
    assert commands.modes_of_environment({}) == ([], 1)
    for level in (1, 2, 3, 4):
        kept = one(commands.remove_some(F.col("t"), F.lit(5), level), ["-o x", "-W", "-g", "-g", "-c", "-O2"])
        assert {"-o x", "-c"} <= set(kept) and kept == [a for a in ["-o x", "-W", "-g", "-g", "-c", "-O2"] if a in kept]


def test_modes_and_variants(spark):
    assert mutate.replace_mode("==", "=") == "replace_double_equal_with_equal"
    for wrong in (lambda: mutate.replace_mode("a", "b"), lambda: mutate.variants(None, "insert")):
        with pytest.raises(ValueError):
            wrong()
    docs = spark.createDataFrame([(1, "a:::b [x, &y] (z)"), (2, ""), (3, None)], "doc_id long, text string")
    by = lambda mode: sorted((r.id, r.mode, r.modified) for r in mutate.variants(docs, mode).collect())
    assert [m for _, k, m in by("replace_all") if k == "replace_double_colon_with_colon"] == ["a::b [x, &y] (z)"] * 2
    assert by("replace_colon_with_semicolon")[0] == (1, "replace_colon_with_semicolon", "a::;b [x, &y] (z)")
    assert (1, "remove_ampersand", "a:::b [x, y] (z)") in by("remove_single") and len(by("remove_single")) == 5
    assert by("remove_pair") == [(1, "remove_brackets", "a:::b x, &y (z)"), (1, "remove_parentheses", "a:::b [x, &y] z")]
    assert by("remove_parentheses") == [(1, "remove_parentheses", "a:::b [x, &y] z")]
    assert (1, "toggle", "[&x, y]") in by("lambda_captures") and len(by("lambda_captures")) == 8
    once = mutate.distinct_places(spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "file int, at int"), ["file", "at"])
    assert once.count() == 2
    put = values(spark, mutate.apply_variant(F.col("t"), F.lit(1), F.lit("X")), "a\nb\nc")
    assert put == ["a\nX\nc"]
    assert mutate.line_at("a\\\nb\nc", 0) == "a\\\nb" and mutate.line_at("a\nb\\", 2) == "b\\" and mutate.line_at("", 0) == ""


def test_coverage_functions(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["a", "expected-error", "b", "c"])], "file string, pos int, value string")
    assert [r.since for r in coverage.lookback(lines, "file", "pos", "value", "expected-error").orderBy("pos").collect()][-1] == "expected-error\nb\nc"
    left, right, done = spark.createDataFrame([("a",), ("b",)], "f string"), spark.createDataFrame([(1,), (2,)], "e int"), spark.createDataFrame([("a", 1)], "f string, e int")
    assert sorted(map(tuple, coverage.pending(left, right, done, ["f", "e"]).collect())) == [("a", 2), ("b", 1), ("b", 2)]
    with pytest.raises(ValueError):
        coverage.pending(left, right, done, ["f", "e"], most=1)
    tries = [("k", 1, False, False), ("k", 2, False, True), ("k", 3, True, True), ("n", 1, False, None), ("s", 1, True, False)]
    got = coverage.attempts(spark.createDataFrame(tries, "k string, i int, s boolean, l boolean"), "k", ["i"], F.col("s"), F.col("l"))
    assert sorted(map(tuple, got.collect())) == [("k", 2, 2, "large", 2), ("n", 1, 1, None, None), ("s", 1, 0, "small", 1)]


def test_parenthesis_needs_a_node(spark):
    nodes = spark.createDataFrame([(1, [0], "CALL_EXPR", 1, 1, 0, 5)], "tree_id int, path array<int>, kind string, line_start int, line_end int, col_start int, col_end int")
    places = spark.createDataFrame([(1, 1, 5, "("), (1, 1, 6, ")"), (1, 1, 2, "x")], "tree_id int, line int, col int, symbol string")
    assert sorted((r.col, r.kind) for r in tree.parenthesis_owner(nodes, places).collect()) == [(5, "CALL_EXPR"), (6, None)]


def test_runs_time_out_and_rerun_the_original(spark):
    def compiler(c):
        if c[0] == "slow":
            raise TimeoutError
        return (1, "bad") if c[0] == "bad" else (0, "")

    rows = spark.createDataFrame([(["slow"], ["ok"]), (["bad"], ["bad"]), (["ok"], ["ok"])], "command array<string>, original array<string>")
    got = runner.run_variants(rows, compiler, original="original").collect()
    assert sorted((r.status, r.message, r.original_ok) for r in got) == [("ERROR", "bad", False), ("SUCCESS", "", True), ("TIMEOUT", "", True)]


def test_ledger_of_a_stream_forgets_nothing(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1), ("b", 1)], [("a", 9)], [("c", 2), ("b", 9)]):
        spark.createDataFrame(part, "key string, at int").coalesce(1).write.mode("append").json(path)
        stream = ingest.new_keys(ingest.stream_log(spark, path, "key string, at int"), "key")
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.key, r["at"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_shared_folder_is_the_named_one(spark):
    assert inputs.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
