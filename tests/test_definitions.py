"""Definition files, the template compiler's substitutions, the rule index and closures of groups."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.functions.templates import Compiler
from tracefold.operators import groups, match
from tracefold.sources import definitions

TEXT = """// def err_in_comment : Error<"no">;
/* def err_in_block : Error<"no">; */
let Component = "Parse" in {
def sub_kind : TextSubstitution<"%select{a|b}0">;
def err_blank : Error <"blank > before, ; bracket">;
def ext_first : ExtWarn<"extension %sub{sub_kind}0">, InGroup<Some>, DefaultIgnore;
def err_lines
  : Error<
  "one \\"two\\" "   // a note > ,
  "three">, DefaultFatal, CatX;
def note_it : Note<"said %0 here">;
def err_named : Error<
  note_it.Summary>;
def warn_own : Warning<"w">, InGroup<DiagGroup<"own-flag", [Some, Other]>>, DefaultError;
def Some : DiagGroup<"some">;
def Other : DiagGroup<"other", [Some, // nested
  Missing]> { code Documentation = [{ def err_in_code : Error<"no">; }]; }
def err_blank : Error<"a later one">;
def not_a_diagnostic : Thing<3>;
def err_open : Error<"nothing closes this";
def err_after : Error<"still read">;
}
"""


def test_records():
    found = {r.name: definitions._described(TEXT, r) for r in definitions.records_of(TEXT)}
    assert "err_in_comment" not in found and "err_in_block" not in found and "err_in_code" not in found
    assert found["err_blank"]["summary"] == "a later one"
    assert (found["ext_first"]["severity"], found["ext_first"]["group_name"], found["ext_first"]["flag"]) == ("ignored", "Some", None)
    assert (found["err_lines"]["summary"], found["err_lines"]["raw"], found["err_lines"]["severity"], found["err_lines"]["mixins"]) == ('one \\"two\\" three', 'one \\"two\\" three', "fatal", ["DefaultFatal", "CatX"])
    assert (found["warn_own"]["severity"], found["warn_own"]["group_name"], found["warn_own"]["flag"]) == ("error", None, "own-flag")
    assert found["err_named"]["summary"] == "note_it.Summary"
    assert found["err_after"]["summary"] == "still read"


def test_diagnostics_and_groups_of_files(spark):
    files = spark.createDataFrame([("a", TEXT), ("b", None), ("c", "")], "file string, text string")
    got = {r.name for r in definitions.diagnostics(files).collect()}
    assert got == {"err_blank", "ext_first", "err_lines", "note_it", "err_named", "warn_own", "err_open", "err_after"}
    assert sorted((r.name, r.flag, tuple(r.subgroups)) for r in definitions.groups(files).collect()) == [("Other", "other", ("Some", "Missing")), ("Some", "some", ())]


def test_catalogue_has_errors_before_extensions_and_expands(spark, tmp_path):
    (tmp_path / "a.td").write_text(TEXT)
    (tmp_path / "b.td").write_text('def ext_b : ExtWarn<"b">;\ndef err_b : Error<"c %sub{sub_kind}0">;')
    rows = definitions.catalogue(spark, str(tmp_path), mode="fixed").orderBy("rule_ord").collect()
    assert [r.name for r in rows] == ["err_blank", "err_lines", "err_named", "err_open", "err_after", "ext_first", "err_b", "ext_b"]
    patterns = {r.name: r.pattern for r in rows}
    assert patterns["ext_first"] == "extension (a|b)" and patterns["err_b"] == "c (a|b)" and patterns["err_named"] == "said .* here" and patterns["err_blank"] == "a later one"
    plain = {r.name: r.pattern for r in definitions.catalogue(spark, str(tmp_path)).collect()}
    assert plain["ext_first"] == "extension .*" and plain["err_named"] == r"note_it\.Summary"


def test_substitutions_that_lead_back_are_wild():
    c = Compiler("fixed", {"a": "1 %sub{b}0", "b": "2 %sub{a}0,1 %select{x|%sub{c}0}1", "c": "3"})
    assert c.compile("%sub{a}0 and %sub{a}1, %sub{none}0") == "1 2 .* (x|3) and 1 2 .* (x|3), .*"
    assert Compiler("compat", {"a": "1"}).compile("%sub{a}0") == ".*"


# ---- rule index ----

PATTERNS = ["use of .* here", r"a\.b(c|d)e+f", "x|y", "(only|groups)", "[[]class[^]x]tail", "opt(ional)?end", "abc?d", "a{2}bb", "two+three", r"\w+word\d", "(?i)CASE", "lit{eral}", "plain", "p.*", "pl", r"br\{ace\|bar", "n(?:on)capt", "tail$", ".*"]


@pytest.mark.parametrize(("pattern", "text"), [("use of .* here", "use of "), (r"a\.b(c|d)e+f", "a.b"), ("x|y", ""), ("(only|groups)", ""), ("opt(ional)?end", "opt"), ("abc?d", "ab"), ("a{2}bb", "bb"), ("two+three", "three"), ("(?i)CASE", ""), ("lit{eral}", "lit{eral}"), (r"\w+word\d", "word"), (r"br\{ace\|bar", "br{ace|bar")])
def test_held_text(pattern, text):
    assert match.held_text(pattern) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["use of ", "here", "a.b", "c", "d", "e", "f", "x", "class", "tail", "opt", "end", "ab", "bb", "aa", "two", "three", "word", "1", "case", "lit{eral}", "plain", " ", "\n", "br{ace|bar", "non", "capt"]), max_size=6))
def test_index_equals_plain_loop(parts):
    rules = match.usable([(p, p) for p in PATTERNS])
    index, message = match.RuleIndex(rules), "".join(parts)
    want = [n for n, p in rules if re.match(p, message)]
    places = index.candidates(message)
    assert (index.every(message, places) or []) == want and index.first(message, places) == (want[0] if want else None)


def test_rules_that_only_one_engine_accepts(spark):
    rules = [("named", "(?P<n>x).*"), ("open", "[[]x"), ("broken", "a("), ("plain", "y.*")]
    messages = spark.createDataFrame([("xx",), ("[x",), ("yy",), ("zz",), (None,), ("xx",)], "message string")
    for few in (0, 64):
        got = {r.message: (r.n, r.name) for r in match.match_distinct(messages, rules, every=False, few=few).collect()}
        assert got == {"xx": (2, "named"), "[x": (1, "open"), "yy": (1, "plain"), "zz": (1, None), None: (1, None)}
    assert [r.name for r in messages.select(match.first_label(messages.message, rules).alias("name")).collect()] == [None, None, "plain", None, None, None]
    found = match.match_indexed(messages.selectExpr("message", "1 as `a b`"), rules, every=True)
    assert found.columns == ["message", "a b", "names", "n_candidates"] and found.count() == 6


# ---- groups ----


def test_closure_of_random_edges(spark, tmp_path):
    rng = random.Random(4)
    edges = [(f"g{rng.randrange(25)}", f"g{rng.randrange(25)}") for _ in range(30)] + [("g1", "g1"), (None, "g2"), ("g3", None)]
    got = sorted(map(tuple, groups.closure(spark.createDataFrame(edges, "name string, subgroup string"), f"file://{tmp_path}").collect()))
    nodes = {x for e in edges for x in e if x}
    want = {(n, n) for n in nodes}
    while True:
        more = {(a, d) for a, b in want for c, d in edges if b == c and d} - want
        if not more:
            break
        want |= more
    assert got == sorted(want)


def test_closure_of_a_chain_takes_few_rounds(spark, tmp_path):
    """A chain of 20 whose last group holds the fifth: rounds of 1, 2, 4, 8 and 16 steps and one that finds nothing."""
    edges = [(f"g{i}", f"g{i + 1}") for i in range(19)] + [("g19", "g5")]
    got = {tuple(r) for r in groups.closure(spark.createDataFrame(edges, "name string, subgroup string"), f"file://{tmp_path}").collect()}
    assert got == {(f"g{i}", f"g{j}") for i in range(20) for j in range(20) if i <= j or (i > 5 and j >= 5)}
    assert len(list(tmp_path.glob("closure-*/round=*"))) <= 7


def test_files_are_parsed_once_for_groups_and_diagnostics(spark):
    files = spark.createDataFrame([("a", TEXT), ("b", None), ("c", "")], "file string, text string")
    rows = definitions.flagged(files)
    for mine, names in ((rows.where("subgroups is not null"), ["file", "pos", "name", "flag", "subgroups"]), (rows.where("subgroups is null"), ["file", "pos", "name", "group_name", "flag"])):
        whole = definitions.groups(files) if "subgroups" in names else definitions.diagnostics(files)
        assert sorted(map(str, mine.select(names).collect())) == sorted(map(str, whole.select(names).collect()))


def test_switched_flags(spark, tmp_path):
    g = spark.createDataFrame([("A", "a", ["B", "C"]), ("B", "b", ["A"]), ("D", "b", []), ("E", "e", None)], "name string, flag string, subgroups array<string>")
    d = spark.createDataFrame([("A", None), ("C", None), ("C", None), (None, "own"), (None, "b"), (None, None)], "group_name string, flag string")
    got = {r.flag: (r.n_groups, r.n_diagnostics) for r in groups.switched(g, d, f"file://{tmp_path}").collect()}
    assert got == {"a": (3, 3), "b": (4, 4), "e": (1, 0), "own": (0, 1)}
    assert groups.switched(g.limit(0), d.limit(0), f"file://{tmp_path}").collect() == []


def test_count_map_over_several_lines(spark, tmp_path):
    from tracefold.sources import logs

    (tmp_path / "counts.json").write_text('{\n  "a": 3,\n  "b": 0\n}\n')
    assert sorted(map(tuple, logs.read_count_map(spark, str(tmp_path / "counts.json")).collect())) == [("a", 3), ("b", 0)]
