from tracefold.operators import coverage, match, mutate
from tracefold.sources import definitions, logs, runner


def test_catalogue_from_files(spark, tmp_path):
    (tmp_path / "A.td").write_text('def err_a : Error<"bad %0">;\ndef err_b : Error<"%0">;\n')
    (tmp_path / "B.td").write_text('def err_a : Error<"worse %0">;\n')
    rows = definitions.catalogue(spark, str(tmp_path)).orderBy("rule_ord").collect()
    assert [(r["name"], r.pattern, r.valid) for r in rows] == [("err_a", "worse .*", True), ("err_b", ".*", True)]
    assert sorted(r["name"] for r in definitions.definition_names(definitions.scan_definitions(spark, str(tmp_path))).collect()) == ["err_a", "err_a", "err_b"]


def test_json_readers_and_count_maps(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"file":"a","message":"m","status":"ERROR"}\nnot json\n')
    assert logs.read_lenient(spark, str(p), logs.AGENT_RUN).select("file", "message").collect()[0].message == "m"
    (tmp_path / "n.json").write_text('{"a": 2, "not_found": 1}')
    counts = logs.read_count_map(spark, str(tmp_path / "n.json"))
    merged = coverage.merge_counts(counts, counts)
    assert {r["name"]: r.n for r in merged.collect()} == {"a": 4, "not_found": 2}
    assert logs.count_map_json(merged).first().json == '{"a":4,"not_found":2}'


def test_ledger_round_trip_and_sources(spark, tmp_path):
    done = spark.createDataFrame([(7, "a.c", 3, "err_x")], "id long, file string, line int, name string")
    logs.append_ledger(done, str(tmp_path / "ledger"))
    assert [r.id for r in logs.read_ledger(spark.read.text(str(tmp_path / "ledger"))).collect()] == [7]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.cpp").write_bytes("é".encode())
    (tmp_path / "src" / "b.c").write_bytes(b"\xe9")
    (tmp_path / "src" / "c.txt").write_bytes(b"x")
    assert sorted(r.text for r in logs.read_sources(spark, str(tmp_path / "src")).collect()) == ["é", "é"]


def test_attempt_log_entries(spark):
    lines = ["2024-11-18 17:08:14,1 - INFO - head", "more", "2024-11-18 17:08:15,2 - ERROR - next"]
    rows = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, pos int, value string")
    assert [(r.level, r.message) for r in logs.read_attempts(rows).orderBy("entry").collect()] == [("INFO", "head\nmore"), ("ERROR", "next")]


def test_matchers_agree_and_skip_bad_rules(spark):
    rules = [("bad", "("), ("all", ".*"), ("a", "x.*"), ("b", "x y")]
    rows = spark.createDataFrame([("x y",), ("x y",), ("z",), ("x\ny",)], "message string")
    for every in (True, False):
        few, many = (sorted(map(repr, match.match_distinct(rows, rules, every, few=n).collect())) for n in (64, 0))
        assert few == many
    counts = {r["name"]: r.n for r in match.label_counts(match.match_distinct(rows, rules, False)).collect()}
    assert counts == {"a": 3, "not_found": 1}


def test_bracket_pairs_and_runner(spark):
    assert mutate.bracket_pairs("(a(b))]", {"(": ")", "[": "]"}) == [(0, 5), (2, 4)]
    v = spark.createDataFrame([(["clang", "a.c"],), (["clang", "b.c"],)], "command array<string>")
    out = runner.run_variants(v, lambda c: (0, "") if c[1] == "a.c" else (1, "boom")).collect()
    assert sorted((r.status, r.message) for r in out) == [("ERROR", "boom"), ("SUCCESS", "")]
