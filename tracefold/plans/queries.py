"""Registered queries over the tables; each has the SQL that an independent engine checks it with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, templates, text
from ..operators import coverage, groups, match, mutate, tree, variants
from ..sources import definitions, encodings, logs
from . import inputs
from .inputs import ARGV_SQL, LOG_SQL, MESSAGES_SQL, RULES, RULES_SQL, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MATCH_SQL = f"(SELECT m.message, r.ord, r.name FROM {MESSAGES_SQL} m LEFT JOIN {RULES_SQL} ON r.pattern <> '.*' AND regexp_matches(m.message, '^(?:' || r.pattern || ')'))".replace("AS rules(", "AS r(")
DISTINCT_MATCH = MATCH_SQL.replace(f"FROM {MESSAGES_SQL} m", f"FROM (SELECT DISTINCT message FROM {MESSAGES_SQL}) m")


# ---- classification ----


@query(f"""
WITH d AS (SELECT message, arg_min(name, ord) AS name FROM {DISTINCT_MATCH} GROUP BY message),
     c AS (SELECT message, count(*) AS k FROM {MESSAGES_SQL} GROUP BY message)
SELECT name, cast(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(name, 'not_found') AS name, k AS n FROM c JOIN d USING (message) UNION ALL SELECT 'not_found', 0) GROUP BY name
""")
def match_first_counts(spark: SparkSession, sf: str) -> DataFrame:
    return match.label_counts(match.match_distinct(inputs.messages(spark, sf).select("message"), RULES, every=False))


@query(f"SELECT message, string_agg(name, ',' ORDER BY ord) AS labels FROM {DISTINCT_MATCH} GROUP BY message")
def match_all_labels(spark, sf):
    found = match.match_distinct(inputs.messages(spark, sf).select("message"), RULES, every=True)
    return found.select("message", F.array_join("names", ",").alias("labels"))


@query(f"SELECT name, cast(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(name, 'not_found') AS name, 1 AS n FROM {MATCH_SQL} UNION ALL SELECT 'not_found', 0) GROUP BY name")
def match_all_counts(spark, sf):
    return match.label_counts(match.match_distinct(inputs.messages(spark, sf).select("message"), RULES, every=True))


@query(f"SELECT name, cast(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(name, 'not_found') AS name, 1 AS n FROM {MATCH_SQL} UNION ALL SELECT 'not_found', 0) GROUP BY name")
def match_all_counts_batched(spark, sf):
    """The matcher for long rule lists, on the same rules."""
    return match.label_counts(match.match_distinct(inputs.messages(spark, sf).select("message"), RULES, every=True, few=0))


@query(f"SELECT message FROM {MATCH_SQL} WHERE name IS NULL")
def unmatched_messages(spark, sf):
    return match.unmatched(match.match_distinct(inputs.messages(spark, sf).select("message"), RULES, every=False))


@query(rf"SELECT event_id, regexp_replace(content, chr(27) || '\[[0-?]*[ -/]*[@-~]', '', 'g') AS clean FROM {LOG_SQL}")
def strip_ansi(spark, sf):
    return inputs.logs(spark, sf).select("event_id", text.strip_ansi(F.col("content")).alias("clean"))


@query(f"SELECT event_id, message FROM {MESSAGES_SQL}")
def extract_messages(spark, sf):
    return inputs.messages(spark, sf)


@query("SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, count(*) AS n FROM events GROUP BY 1")
def status_split(spark, sf):
    return table(spark, sf, "events").groupBy(F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, cast(json_extract_string(p, '$.k') AS BIGINT) AS k FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, 3) ELSE props END AS p FROM events) WHERE json_valid(p) AND json_extract_string(p, '$.k') IS NOT NULL""")
def json_props_lenient(spark, sf):
    broken = F.expr("CASE WHEN event_id % 10 = 0 THEN left(props, 3) ELSE props END")
    return table(spark, sf, "events").select("event_id", F.from_json(broken, "k bigint")["k"].alias("k")).where("k is not null")


# ---- coverage ----


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def merge_count_maps(spark, sf):
    e = table(spark, sf, "events")
    maps = [e.where(F.col("user_id") % 4 == i).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")) for i in range(4)]
    return coverage.merge_counts(*maps)


_WORDS = "'hip_', 'Cuda_', 'OMP_', 'acc_', 'Microsoft_', 'ObjC_', 'mips_', 'AArch64_', 'ppe_', 'x_MS_', 'x_amd_', 'Apple_', 'macOS_', 'x_ARM_', 'arm_', 'ms_', 'amd_', 'openmp_', 'charm_', ''"
_NAME = "concat(CASE WHEN p_size % 3 = 0 THEN 'warn_' ELSE 'err_' END, {word}, replace(lower(p_type), ' ', '_'), '_', p_partkey % 50)"
NAMES_SQL = f"(SELECT p_partkey, {_NAME.format(word=f'list_extract([{_WORDS}], (p_partkey % 20 + 1)::INT)')} AS name FROM part)"


def _names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_NAME.format(word=f"element_at(array({_WORDS}), cast(p_partkey % 20 + 1 as int))")).alias("name"))


@query(f"""SELECT p_partkey, name FROM {NAMES_SQL} WHERE NOT (contains(lower(name), 'hip') OR contains(lower(name), 'cuda') OR contains(lower(name), 'omp') OR contains(lower(name), 'acc')
 OR contains(lower(name), 'microsoft') OR contains(lower(name), 'objc') OR contains(lower(name), 'mips') OR contains(lower(name), 'aarch64') OR contains(lower(name), 'ppe') OR contains(lower(name), '_ms')
 OR contains(lower(name), '_amd') OR contains(lower(name), 'apple') OR contains(lower(name), 'macos') OR contains(lower(name), '_arm'))""")
def catalog_platform_filter(spark, sf):
    return _names(spark, sf).where(~coverage.contains_any(F.col("name")))


@query(f"SELECT p_partkey, name FROM {NAMES_SQL} WHERE contains(name, 'err_')")
def catalog_err_filter(spark, sf):
    return _names(spark, sf).where(F.col("name").contains("err_"))


def _gap(spark, sf):
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return coverage.gap(table(spark, sf, "part").select("p_partkey", "p_name"), seen, "p_partkey")


GAP_SQL = "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)"


@query(GAP_SQL)
def coverage_gap(spark, sf):
    """The place in the catalogue is the part's key, so no task needs all rows to number them."""
    return _gap(spark, sf)


@query(f"{GAP_SQL} ORDER BY p_partkey LIMIT 100 OFFSET 50")
def coverage_gap_slice(spark, sf):
    return coverage.sliced(_gap(spark, sf), "p_partkey", 50, 150)


@query("SELECT concat(p_type, p_brand) AS name FROM part WHERE concat(p_type, p_brand) NOT IN (SELECT concat(p_type, p_brand) FROM part WHERE p_size > 48)")
def bag_anti(spark, sf):
    """Names that repeat stay as often as they are listed."""
    p = table(spark, sf, "part").select(F.concat("p_type", "p_brand").alias("name"), "p_size")
    return coverage.gap(p.select("name"), p.where("p_size > 48"), "name")


@query("SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS place FROM (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1)")
def count_histogram_desc(spark, sf):
    return coverage.ranked(table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def first_location_per_key(spark, sf):
    return coverage.first_per_key(table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT l_partkey, string_agg(concat(l_orderkey, ':', l_linenumber), ',' ORDER BY l_orderkey, l_linenumber) AS locations FROM lineitem GROUP BY 1")
def locations_per_key(spark, sf):
    found = coverage.collected(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey", "l_linenumber")
    return found.select("l_partkey", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["l_orderkey"].cast("string"), p["l_linenumber"].cast("string"))), ",").alias("locations"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3")
def top3_per_key(spark, sf):
    return coverage.top_per_key(table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", 3, "l_orderkey", "l_linenumber")


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'F'")
def distinct_finished(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY 1")
def err_conditional_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))


@query("""SELECT c_custkey, r_regionkey FROM customer, region WHERE NOT EXISTS (
 SELECT 1 FROM orders JOIN customer c2 ON o_custkey = c2.c_custkey JOIN nation ON c2.c_nationkey = n_nationkey WHERE o_custkey = customer.c_custkey AND n_regionkey = r_regionkey)""")
def pending_work(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    done = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("r_regionkey")).distinct()
    return coverage.pending(customer.select("c_custkey"), table(spark, sf, "region").select("r_regionkey"), done, ["c_custkey", "r_regionkey"])


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, '') AS name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def id_name_lookup(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("")).alias("name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def contains_target(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


# ---- text ----

OFFSET = "cast(doc_id * 37 % greatest(length(text), 1) as int)"


@query(r"""SELECT doc_id, concat(CASE WHEN o = 0 THEN '' ELSE string_split(left(t, o), chr(10))[-1] END, regexp_extract(substr(t, o + 1), '^((?:[^\n]*\\\n)*[^\n]*)', 1)) AS line
FROM (SELECT doc_id, replace(text, ', ', ',\' || chr(10)) AS t, cast(doc_id * 37 % greatest(length(text), 1) AS INT) AS o FROM documents)""")
def line_at_offset(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit(",\\\n")).alias("t"), F.expr(OFFSET).alias("o"))
    return d.select("doc_id", text.line_at_offset(F.col("t"), F.col("o")).alias("line"))


@query("SELECT doc_id, len(string_split(left(text, o), chr(10))) AS line_no FROM (SELECT doc_id, text, cast(doc_id * 37 % greatest(length(text), 1) AS INT) AS o FROM documents)")
def line_number_at_offset(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.line_number(F.col("text"), F.expr(OFFSET)).alias("line_no"))


ANNOTATED = "concat(text, '\n// expected-error {{ bad thing ', cast(doc_id as string), ' }}\nx; // expected-error@+1{{other}} expected-error 2 {{no}}')"


_ANNOTATION = r"(expected-error(?:@(?:\+\d+|[\w.]+:\*?))?)\s*\{\{([^}]+)\}\}"


@query(rf"""SELECT doc_id, full_text, trim(content) AS content, CASE k WHEN 1 THEN breaks + 2 ELSE breaks + 3 END AS line FROM (
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS breaks, unnest(range(1, len(regexp_extract_all(t, '{_ANNOTATION}', 0)) + 1)) AS k,
 unnest(regexp_extract_all(t, '{_ANNOTATION}', 0)) AS full_text, unnest(regexp_extract_all(t, '{_ANNOTATION}', 2)) AS content
FROM (SELECT doc_id, text, concat(text, chr(10), '// expected-error {{{{ bad thing ', doc_id, ' }}}}', chr(10), 'x; // expected-error@+1{{{{other}}}} expected-error 2 {{{{no}}}}') AS t FROM documents WHERE text IS NOT NULL))""")
def expected_annotations(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(text.expected_annotations(F.expr(ANNOTATED))).alias("a"))
    return d.select("doc_id", F.col("a.full").alias("full_text"), F.col("a.content").alias("content"), F.col("a.line").alias("line"))


@query("SELECT conv_id, turn, replace(replace(replace(replace(replace(c, '```python', ''), '```cpp', ''), '```c++', ''), '```c', ''), '```', '') AS code FROM (SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN '```cpp' WHEN 1 THEN '```c++' WHEN 2 THEN '```c' ELSE '```python' END, chr(10), text, chr(10), '```') AS c FROM conversations)")
def code_deformat(spark, sf):
    c = F.expr("concat(CASE turn % 4 WHEN 0 THEN '```cpp' WHEN 1 THEN '```c++' WHEN 2 THEN '```c' ELSE '```python' END, '\n', text, '\n```')")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.code_deformat(c).alias("code"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n_lines FROM documents")
def line_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@query(r"SELECT page_id, url FROM (SELECT page_id, concat(regexp_replace(url, '[?#].*', ''), CASE page_id % 4 WHEN 0 THEN '.cpp' WHEN 1 THEN '.c' WHEN 2 THEN '.h' ELSE '.cc' END) AS url FROM pages) WHERE regexp_matches(url, '\.(c|cpp|cxx|cc|c\+\+)$')")
def extension_filter(spark, sf):
    url = F.expr(r"concat(regexp_replace(url, '[?#].*', ''), CASE page_id % 4 WHEN 0 THEN '.cpp' WHEN 1 THEN '.c' WHEN 2 THEN '.h' ELSE '.cc' END)")
    return table(spark, sf, "pages").select("page_id", url.alias("url")).where(text.has_source_extension(F.col("url")))


@query("SELECT event_id, cast(unnest([user_id, event_id % 100]) AS BIGINT) AS diag_id FROM events")
def diag_id_extract(spark, sf):
    t = F.expr("concat('x DiagID: ', user_id, '\ny DiagID:', event_id % 100, '\nDiagID: none')")
    return table(spark, sf, "events").select("event_id", F.explode(text.diag_ids(t)).alias("diag_id"))


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(t, '(?m)^[ \t]+', '', 'g'), chr(34), ''), '//[^\n]*\n', chr(10), 'g'), '\n|\t|\\n', '', 'g'), ' +', ' ', 'g')) AS summary FROM (SELECT item_id, concat('  ', chr(34), text, '  x', chr(34), '// note', chr(10), chr(9), chr(34), 'end\n', chr(34)) AS t FROM benchmark)")
def normalise_summary(spark, sf):
    t = F.concat(F.lit('  "'), F.col("text"), F.lit('  x"// note\n\t"end\\n"'))
    return table(spark, sf, "benchmark").select("item_id", text.normalise_summary(t).alias("summary"))


TEMPLATES = (
    "expected %0", "use of %select{class|struct|%1}0 type", "%plural{1:error|:errors}0 in %q1", "%diff{from $ to $|types}0,1 (%s2) %ordinal3", 'a.b*c? "%0"', "%sub{base}0,1 and %select{a|%select{b|c}1}0",
    "%s10 of %10", "%diff{x %select{p|q}2 $|y}0,1", "%select{a|%select{b|%select{c|d}2}1}0", "%diff{$ %select{$|z}0|w}0,1", "%select{%plural{1:a|:b}0|x}1", "%diff{a $|b}10,1 c",
    "see %sub{twice}0,12", "%select{%sub{base}1|no}0 %sub{round}3",
)
#: What %sub stands for: one within another, and one that leads back to itself.
SUBSTITUTIONS = {"base": "the '%0' of %select{this|that}1", "twice": "%sub{base}0,1 (again)", "round": "x %sub{back}0", "back": "y %sub{round}0"}


@query(r"""SELECT p_partkey, mode, concat(pattern, ' ', p_type) AS pattern FROM part JOIN (VALUES
 (0, 'compat', 'expected .*'), (1, 'compat', 'use of (class|struct|.*) type'), (2, 'compat', '(error|errors) in .*'), (3, 'compat', '(from .* to .*|types) \(.*\) .*'),
 (4, 'compat', 'a\.b\*c\? .*'), (5, 'compat', '.* and (a|(b|c))'), (6, 'compat', '.* of .*0'), (7, 'compat', '(x (p|q) .*|y)'), (8, 'compat', '(a|(b|%select\{c|d)\}1)'),
 (9, 'compat', '(.* (\.*|z)|w)'), (10, 'compat', '(%plural\{1:a|:b\}0|x)'), (11, 'compat', '(a .*|b),1 c'), (12, 'compat', 'see .*2'), (13, 'compat', '(%sub\{base\}1|no) .*'),
 (0, 'fixed', 'expected .*'), (1, 'fixed', 'use of (class|struct|.*) type'), (2, 'fixed', '(error|errors) in .*'), (3, 'fixed', '(from .* to .*|types) \(.*\) .*'),
 (4, 'fixed', 'a\.b\*c\? ".*"'), (5, 'fixed', 'the ''.*'' of (this|that) and (a|(b|c))'), (6, 'fixed', '.* of .*'), (7, 'fixed', '(x (p|q) .*|y)'), (8, 'fixed', '(a|(b|(c|d)))'),
 (9, 'fixed', '(.* (.*|z)|w)'), (10, 'fixed', '((a|b)|x)'), (11, 'fixed', '(a .*|b) c'), (12, 'fixed', 'see the ''.*'' of (this|that) \(again\)'), (13, 'fixed', '(the ''.*'' of (this|that)|no) x y .*')
) AS t(template_id, mode, pattern) ON p_partkey % 14 = template_id""")
def template_to_regex(spark, sf):
    """A template for each part, its type behind it."""
    template = F.concat(F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int")), F.lit(" "), "p_type")
    rows = table(spark, sf, "part").select("p_partkey", template.alias("template"))
    both = [rows.select("p_partkey", F.lit(m).alias("mode"), templates.compiled(F.col("template"), m, SUBSTITUTIONS).alias("pattern")) for m in ("compat", "fixed")]
    return both[0].unionByName(both[1])


# ---- long catalogues, definition files, groups ----

_PIECES = "SELECT item_id * 3 + p AS ord, concat('item_', item_id, '_', p) AS name, substr(text, 1 + 40 * p, 25) AS s FROM benchmark, (SELECT unnest([0, 1, 2]) AS p)"
_TRIED = f"""WITH lines AS (SELECT line, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY 1),
 rules AS (SELECT * FROM ({_PIECES}) WHERE length(s) = 25 AND NOT contains(s, chr(10))),
 tried AS (SELECT line, ord, name, contains(substr(line, strpos(line, s) + 25), '.') AS hit FROM lines, rules WHERE contains(line, s))"""


def _piece_rules(spark, sf) -> list[tuple[str, str]]:
    """Rules from the passages of ``benchmark``, a catalogue of fixed size: 25 characters somewhere, a full stop after them."""
    piece = F.substring("text", 1 + 40 * F.col("p"), F.lit(25))
    rows = table(spark, sf, "benchmark").withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("s", piece).where((F.char_length("s") == 25) & ~F.col("s").contains("\n"))
    pattern = F.concat(F.lit(".*"), F.regexp_replace("s", r"([\\.^$*+?{}\[\]()|])", r"\\$1"), F.lit(r".*\."))
    return [tuple(r) for r in rows.orderBy("item_id", "p").select(F.concat_ws("_", F.lit("item"), "item_id", "p"), pattern).collect()]


def _lines(spark, sf) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("message"))
    return lines.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_TRIED} SELECT md5(l.line) AS line_md5, any_value(n) AS n, arg_min(name, ord) FILTER (WHERE hit) AS name, cast(count(ord) AS INT) AS n_candidates FROM lines l LEFT JOIN tried t ON l.line = t.line GROUP BY l.line")
def match_catalogue_first(spark, sf):
    """Every line of the documents against a long catalogue, by the index; the rules tried are counted."""
    found = match.match_indexed(_lines(spark, sf), _piece_rules(spark, sf), every=False)
    return found.select(F.md5("message").alias("line_md5"), "n", "name", "n_candidates")


@query(f"{_TRIED} SELECT md5(line) AS line_md5, string_agg(name, ',' ORDER BY ord) AS names FROM tried WHERE hit GROUP BY line")
def match_catalogue_all(spark, sf):
    found = match.match_indexed(_lines(spark, sf), _piece_rules(spark, sf), every=True).where("names is not null")
    return found.select(F.md5("message").alias("line_md5"), F.array_join("names", ",").alias("names"))


def _definition_files(spark, sf) -> DataFrame:
    """A file for each item: a group with subgroups, an error over two lines and a warning with a group of its own."""
    text = F.expr(r"""concat('// a note > , ; "\nlet Component = "', coalesce(kind, ''), '" in {\ndef G', item_id, ' : DiagGroup<"f-', item_id, '", [G', item_id * 2 + 1, ', G', item_id * 2 + 2,
 CASE WHEN item_id % 10 = 5 THEN concat(', G', (item_id - 1) div 2) ELSE '' END, ']>;\n/* def err_no : Error<"no">; */\ndef err_', item_id, '\n  : Error <\n  "bad ', coalesce(name, ''), ' > , ; %0"  // why\n  " of kind \\"x\\" %select{a|b}1">',
 CASE size % 3 WHEN 0 THEN ', DefaultFatal' WHEN 1 THEN concat(', InGroup<G', item_id, '>') ELSE '' END, ';\ndef warn_', item_id, ' : ', CASE WHEN price > 100 THEN 'Warning' ELSE 'ExtWarn' END, '<"use ', coalesce(name, ''), '">, InGroup<DiagGroup<"own-', item_id % 7, '">>',
 CASE WHEN size % 5 = 0 THEN ', DefaultError' ELSE '' END, ';\n}\n')""")
    return table(spark, sf, "items").where("item_id is not null").select(F.col("item_id").cast("string").alias("file"), text.alias("text"))


@query(r"""WITH i AS (SELECT *, coalesce(name, '') AS title FROM items WHERE item_id IS NOT NULL)
SELECT item_id, concat('err_', item_id) AS name, 'Error' AS kind, trim(regexp_replace(concat('bad ', title, ' > , ; %0 of kind \"x\" %select{a|b}1'), '\s+', ' ', 'g')) AS summary, CASE WHEN size % 3 = 0 THEN 'fatal' ELSE 'error' END AS severity,
 CASE WHEN size % 3 = 1 THEN concat('G', item_id) END AS group_name, cast(NULL AS VARCHAR) AS flag FROM i
UNION ALL SELECT item_id, concat('warn_', item_id), CASE WHEN price > 100 THEN 'Warning' ELSE 'ExtWarn' END, trim(regexp_replace(concat('use ', title), '\s+', ' ', 'g')), CASE WHEN size % 5 = 0 THEN 'error' ELSE 'warning' END, NULL, concat('own-', item_id % 7) FROM i""")
def definition_records(spark, sf):
    found = definitions.diagnostics(_definition_files(spark, sf))
    return found.select(F.col("file").cast("long").alias("item_id"), "name", "kind", "summary", "severity", "group_name", "flag")


@query("""WITH RECURSIVE i AS (SELECT * FROM items WHERE item_id IS NOT NULL),
 e AS (SELECT item_id AS a, item_id * 2 + 1 AS b FROM i UNION SELECT item_id, item_id * 2 + 2 FROM i UNION SELECT item_id, (item_id - 1) // 2 FROM i WHERE item_id % 10 = 5),
 r(a, b) AS (SELECT a, a FROM (SELECT a FROM e UNION SELECT b FROM e) UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 d AS (SELECT item_id AS g, count(*) AS n FROM i WHERE size % 3 = 1 GROUP BY 1)
SELECT concat('f-', a) AS flag, count(*) AS n_groups, cast(coalesce(sum(n), 0) AS BIGINT) AS n_diagnostics FROM r JOIN (SELECT DISTINCT item_id AS a FROM i) USING (a) LEFT JOIN d ON b = g GROUP BY 1
UNION ALL SELECT concat('own-', item_id % 7), 0, count(*) FROM i GROUP BY 1""")
def warning_flags(spark, sf):
    """What each flag switches, through all subgroups; some groups hold each other."""
    import uuid

    files, base = _definition_files(spark, sf), f"{inputs.shared_dir(spark)}/definitions-{uuid.uuid4().hex}"
    rows = definitions.flagged(files)
    rows.write.parquet(base)
    rows = spark.read.schema(rows.schema).parquet(base)
    return groups.switched(rows.where("subgroups is not null"), rows.where("subgroups is null"), inputs.shared_dir(spark))


@query("""SELECT event_id, concat_ws(',', coalesce(a.p_name, ''), coalesce(b.p_name, ''), coalesce(a.p_name, '')) AS names FROM events LEFT JOIN part a ON a.p_partkey = user_id LEFT JOIN part b ON b.p_partkey = event_id % 5000""")
def diag_names_of_message(spark, sf):
    """Identifiers in a message to their names; two are known or not, one repeats."""
    t = F.expr("concat('x DiagID: ', user_id, '\ny DiagID:', event_id % 5000, '\nDiagID: none DiagID: ', user_id)")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("row"), text.diag_ids(t).alias("ids"))
    found = coverage.names_of(rows, "ids", table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")
    return found.select(F.col("row").alias("event_id"), F.array_join("names", ",").alias("names"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(string_split(replace(concat('// RUN: a', chr(10), text), '. ', concat('.', chr(10), '// RUN: ')), chr(10)), lambda x: starts_with(x, '// RUN:'))[1:5], '|') AS lines FROM conversations WHERE text IS NOT NULL""")
def run_lines(spark, sf):
    t = F.replace(F.concat(F.lit("// RUN: a\n"), F.col("text")), F.lit(". "), F.lit(".\n// RUN: "))
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(text.run_lines(t), "|").alias("lines"))


@query("""SELECT event_id, concat_ws('|', '#pragma omp for', CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'for (;;)' END, CASE WHEN event_id % 2 = 0 THEN concat('f(', user_id, ');') END) AS scope, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 3 END AS last
 FROM events WHERE event_id % 5 <> 0""")
def pragma_scope(spark, sf):
    """The pragma is on line 2; on every fifth text line 2 is another."""
    t = F.expr("concat('int a;\n', CASE WHEN event_id % 5 = 0 THEN 'x' ELSE ' #pragma omp for ' END, '\n', CASE WHEN event_id % 2 = 0 THEN concat('  f(', user_id, ');') ELSE ' for (;;)' END, '\n}\n;')")
    rows = table(spark, sf, "events").select("event_id", text.pragma_scope(t, F.lit(2)).alias("s")).where("s is not null")
    return rows.select("event_id", F.array_join("s.lines", "|").alias("scope"), F.col("s.end").alias("last"))


@query("""SELECT l_partkey, coalesce(solved_at, places) AS n_small, coalesce(solved_at, places) - CASE WHEN solved_by = 'small' THEN 1 ELSE 0 END AS n_large, solved_by, solved_at FROM (
 SELECT l_partkey, max(k) AS places, min(k) FILTER (WHERE s OR l) AS solved_at, arg_min(CASE WHEN s THEN 'small' ELSE 'large' END, k) FILTER (WHERE s OR l) AS solved_by FROM (
  SELECT l_partkey, l_quantity > 44 AS s, l_discount > 0.07 AS l, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1)""")
def attempts_until_success(spark, sf):
    return coverage.attempts(table(spark, sf, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"], F.col("l_quantity") > 44, F.col("l_discount") > 0.07)


# ---- commands ----


@query(rf"""SELECT event_id, CASE WHEN contains(argv[1], '++') THEN 'clang++' ELSE 'clang' END AS compiler, argv[12] AS source_file,
 concat_ws('|', argv[2], argv[3], argv[4] || ' ' || argv[5], argv[6] || ' ' || argv[7], argv[8], argv[9], argv[10], argv[11]) AS other_params FROM {ARGV_SQL}""")
def command_parse(spark, sf):
    c = inputs.argv(spark, sf).select("event_id", commands.parse(F.col("argv")).alias("c"))
    return c.select("event_id", F.col("c.compiler"), F.array_join("c.source_file", "|").alias("source_file"), F.array_join("c.other_params", "|").alias("other_params"))


@query(f"SELECT event_id, replace(replace(array_to_string(argv, ' '), '%clang_cc1', 'clang -cc1'), '%itanium_abi_triple', 'x86_64-unknown-linux-gnu') AS command FROM {ARGV_SQL}")
def command_rewrite(spark, sf):
    return inputs.argv(spark, sf).select("event_id", F.array_join(commands.rewrite(F.col("argv")), " ").alias("command"))


@query(f"SELECT event_id, s AS standard, array_to_string(list_append(list_filter(argv, lambda x: NOT starts_with(x, '-std=c++')), '-std=c++' || s), ' ') AS command FROM {ARGV_SQL}, (SELECT unnest(['98','03','11','14','17','20']) AS s)")
def std_sweep(spark, sf):
    swept = inputs.argv(spark, sf).select("event_id", F.explode(commands.sweep(F.col("argv"))).alias("c"))
    return swept.select("event_id", F.substring(F.element_at("c", -1), 9, 9).alias("standard"), F.array_join("c", " ").alias("command"))


CL_ARGV = "list_concat(argv, ['-fopenmp-version=51', '-fopenmp'])"


@query(f"SELECT event_id, s AS standard, array_to_string(list_append(list_filter({CL_ARGV}, lambda x: NOT starts_with(x, '-fopenmp-version')), '-cl-std=clc++' || s), ' ') AS command FROM {ARGV_SQL}, (SELECT unnest(['1.0', '1.1', '1.2', '2.0', '2.1', '3.0']) AS s)")
def cl_sweep(spark, sf):
    argv = F.concat("argv", F.array(F.lit("-fopenmp-version=51"), F.lit("-fopenmp")))
    swept = inputs.argv(spark, sf).select("event_id", F.explode(commands.cl_sweep(argv)).alias("c"))
    return swept.select("event_id", F.substring(F.element_at("c", -1), 14, 9).alias("standard"), F.array_join("c", " ").alias("command"))


ORDERED_SQL = f"(SELECT event_id, argv, list_transform(list_sort(list_transform(argv, lambda a, i: struct_pack(k := md5(concat_ws('|', event_id, i - 1, a)), a := a))), lambda s: s.a) AS dealt FROM {ARGV_SQL})"


@query(f"SELECT event_id, array_to_string(dealt, ' ') AS command FROM {ORDERED_SQL}")
def args_reorder(spark, sf):
    return inputs.argv(spark, sf).select("event_id", F.array_join(commands.seeded_order(F.col("argv"), F.col("event_id")), " ").alias("command"))


@query(f"""SELECT event_id, array_to_string(list_filter(argv, lambda a: NOT list_contains(gone, a)), ' ') AS command FROM (
 SELECT event_id, argv, list_filter(dealt[1:least(len(argv), 1 + (('0x' || left(md5(cast(event_id AS VARCHAR)), 7))::BIGINT % greatest(len(argv) // 2 + 1, 1)))], lambda a: NOT regexp_matches(a, '^-[oILc]')) AS gone FROM {ORDERED_SQL})""")
def args_remove(spark, sf):
    return inputs.argv(spark, sf).select("event_id", F.array_join(commands.remove_some(F.col("argv"), F.col("event_id"), level=2), " ").alias("command"))


@query("""SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(['replace_all', CASE WHEN user_id % 2 = 0 THEN 'remove_pair' ELSE 'insert' END, CASE event_type WHEN 'click' THEN 'agent' WHEN 'view' THEN 'replace_all' ELSE 'nothing' END], lambda m: m IN ('replace_all', 'remove_pair', 'agent')))), ',') AS modes FROM events""")
def mode_normalise(spark, sf):
    raw = F.expr("concat(' replace_all,', CASE WHEN user_id % 2 = 0 THEN 'remove_pair' ELSE 'insert' END, ' & ', CASE event_type WHEN 'click' THEN 'agent' WHEN 'view' THEN 'replace_all' ELSE 'nothing' END)")
    return table(spark, sf, "events").select("event_id", F.array_join(commands.normalise_modes(raw), ",").alias("modes"))


# ---- variants ----

LINES_SQL = "(SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents))"


def _places(symbols: str) -> str:
    return f"(SELECT doc_id, line_no, line, unnest(list_filter(range(0, length(line)), lambda i: contains('{symbols}', c[i + 1]))) AS pos FROM (SELECT doc_id, line_no, line, regexp_extract_all(line, '(?s).') AS c FROM {LINES_SQL}))"


def _variants(v: DataFrame, *more: str) -> DataFrame:
    return v.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("at").cast("long").alias("pos"), *more, F.md5("modified").alias("modified_md5"))


@query(f"SELECT doc_id, line_no, pos, substr(line, pos + 1, 1) AS symbol, md5(substr(line, 1, pos) || substr(line, pos + 2)) AS modified_md5 FROM {_places(mutate.SINGLES)}")
def mutate_delete_symbol(spark, sf):
    return _variants(mutate.delete_symbols(mutate.lines(table(spark, sf, "documents"))), "symbol")


@query(f"SELECT doc_id, line_no, pos, md5(substr(line, 1, pos) || ':' || substr(line, pos + 2)) AS modified_md5 FROM {_places(',')}")
def mutate_replace_symbol(spark, sf):
    return _variants(mutate.replace_symbol(mutate.lines(table(spark, sf, "documents")), ",", ":"))


@query(f"SELECT doc_id, line_no, pos, md5(substr(line, 1, pos) || '==' || substr(line, pos + 2)) AS modified_md5 FROM {_places('=')}")
def mutate_double_symbol(spark, sf):
    return _variants(mutate.replace_symbol(mutate.lines(table(spark, sf, "documents")), "=", "=="))


@query(f"SELECT doc_id, symbol, line_no, pos FROM (SELECT doc_id, substr(line, pos + 1, 1) AS symbol, line_no, pos, row_number() OVER (PARTITION BY doc_id, substr(line, pos + 1, 1) ORDER BY md5(concat_ws('|', 7, doc_id, line_no, pos))) AS k FROM {_places(mutate.SINGLES)}) WHERE k <= 1")
def mutate_sample_k(spark, sf):
    v = mutate.delete_symbols(mutate.lines(table(spark, sf, "documents"))).select("doc_id", "symbol", F.col("line_no").cast("long").alias("line_no"), F.col("at").cast("long").alias("pos"))
    order = F.md5(F.concat_ws("|", F.lit("7"), *(F.col(c).cast("string") for c in ("doc_id", "line_no", "pos"))))
    return mutate.sample_per_group(v, ["doc_id", "symbol"], order, 1)


CODE_SQL = f"(SELECT event_id, user_id, event_type, {inputs.CODE.format(s='VARCHAR', nl='chr(10)', slash='chr(92)')} AS text FROM events)"


def _code(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr(inputs.CODE.format(s="STRING", nl="char(10)", slash="char(92)")).alias("text"))


#: Pairs by depth: a bracket that opens at a level is closed by the next one of its kind there.
PAIRS_SQL = r"""(
 SELECT event_id, user_id, mode, pos AS start_pos, close_pos AS end_pos, concat(CASE WHEN pos = 0 THEN '' ELSE string_split(left(text, pos), chr(10))[-1] END, regexp_extract(substr(text, pos + 1), '^((?:[^\n]*\\\n)*[^\n]*)', 1)) AS line,
  concat(CASE WHEN pos = 0 THEN '' ELSE string_split(left(text, pos), chr(10))[-1] END, regexp_extract(concat(substr(text, pos + 2, close_pos - pos - 1), substr(text, close_pos + 2)), '^((?:[^\n]*\\\n)*[^\n]*)', 1)) AS modified
 FROM (SELECT *, lead(pos) OVER w AS close_pos, lead(step) OVER w AS next_step FROM (
   SELECT *, sum(step) OVER (PARTITION BY event_id, mode ORDER BY pos) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level FROM (
     SELECT *, CASE WHEN c IN ('(', ')') THEN 'remove_parentheses' WHEN c IN ('[', ']') THEN 'remove_brackets' WHEN c IN ('{', '}') THEN 'remove_braces' ELSE 'remove_angle' END AS mode, CASE WHEN c IN ('(', '[', '{', '<') THEN 1 ELSE -1 END AS step
     FROM (SELECT event_id, user_id, text, pos, substr(text, pos + 1, 1) AS c FROM (SELECT event_id, user_id, text, unnest(range(length(text))) AS pos FROM CODE)) WHERE c IN ('(', ')', '[', ']', '{', '}', '<', '>')))
   WINDOW w AS (PARTITION BY event_id, mode, level ORDER BY pos)) WHERE step = 1 AND next_step = -1)""".replace("CODE", CODE_SQL)


@query(f"SELECT event_id, mode, start_pos, end_pos, line, modified FROM {PAIRS_SQL}")
def mutate_remove_pair(spark, sf):
    return mutate.remove_pairs(_code(spark, sf), "event_id", "text").select(F.col("id").alias("event_id"), "mode", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "line", "modified")


@query(f"SELECT event_id, mode, start_pos FROM (SELECT *, row_number() OVER (PARTITION BY event_id, mode ORDER BY md5(concat_ws('|', 7, event_id, start_pos))) AS k FROM {PAIRS_SQL}) WHERE k <= 1")
def mutate_remove_pair_sampled(spark, sf):
    found = mutate.remove_pairs(_code(spark, sf), "event_id", "text").select(F.col("id").alias("event_id"), "mode", F.col("start").alias("start_pos"))
    return mutate.sample_per_group(found, ["event_id", "mode"], F.md5(F.concat_ws("|", F.lit("7"), F.col("event_id").cast("string"), F.col("start_pos").cast("string"))), 1)


@query(f"SELECT event_id, start_pos, modified, CASE WHEN start_pos < 70 THEN 'COMPOUND_STMT' ELSE 'TRANSLATION_UNIT' END AS node_kind FROM {PAIRS_SQL} WHERE mode = 'remove_parentheses' AND start_pos <> 4")
def mutate_remove_parentheses(spark, sf):
    """The loop's own pair, at place 4, stays: its deepest node is the loop's."""
    node = lambda path, kind, a, b: F.struct(F.array(*map(F.lit, path)).alias("path"), F.lit(kind).alias("kind"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"))
    code = _code(spark, sf)
    nodes = code.select(F.col("event_id").alias("tree_id"), F.explode(F.array(node([0], "TRANSLATION_UNIT", 0, 400), node([0, 0], "FOR_STMT", 0, 70), node([0, 0, 3], "COMPOUND_STMT", 30, 70))).alias("n")).select("tree_id", "n.*")
    return mutate.remove_parentheses(code, "event_id", "text", nodes).select(F.col("id").alias("event_id"), F.col("start").alias("start_pos"), "modified", "node_kind")


def _replace_sql(mode: str, old: str, new: str) -> str:
    return f"SELECT event_id, line_no, '{mode}' AS mode, pos, concat(left(line, pos), '{new}', substr(line, pos + {len(old) + 1})) AS modified FROM (SELECT *, unnest(range(length(line))) AS pos FROM (SELECT event_id, i - 1 AS line_no, l[i] AS line FROM (SELECT event_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {CODE_SQL}))) WHERE substr(line, pos + 1, {len(old)}) = '{old}'"


@query(" UNION ALL ".join(_replace_sql(*x) for x in (
    ("replace_colon_with_double_colon", ":", "::"), ("replace_double_colon_with_colon", "::", ":"), ("replace_colon_with_semicolon", ":", ";"), ("replace_colon_with_comma", ":", ","), ("replace_semicolon_with_colon", ";", ":"),
    ("replace_semicolon_with_comma", ";", ","), ("replace_comma_with_colon", ",", ":"), ("replace_equal_with_double_equal", "=", "=="), ("replace_double_equal_with_equal", "==", "="),
)))
def mutate_replace_all(spark, sf):
    rows = mutate.replace_all(mutate.lines(_code(spark, sf), "event_id", "text"))
    return rows.select("event_id", F.col("line_no").cast("long").alias("line_no"), "mode", F.col("at").cast("long").alias("pos"), "modified")


@query("""SELECT event_id, place, concat(left(text, place), '*', substr(text, place + 1)) AS modified FROM (
 SELECT event_id, text, unnest([CASE WHEN event_id % 3 = 0 THEN 3 ELSE 4 END, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 9 END]) AS place FROM (SELECT event_id, 'int value = w' || user_id || ';' AS text FROM events)) WHERE place IS NOT NULL""")
def mutate_add_asterisk(spark, sf):
    """Per text a declaration (twice: repeated places count once), a reference, a pointer, an overloaded reference and a node of another file."""
    code = table(spark, sf, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("main"), "event_id", F.expr("concat('int value = w', user_id, ';')").alias("text"))
    fields = "kind string, type_kind string, start int, name_start int, type_ref_end int, referenced_kind string, elsewhere boolean"
    node = lambda *v: F.struct(*(v_.cast(t).alias(n) if isinstance(v_, Column) else F.lit(v_).cast(t).alias(n) for v_, (n, t) in zip(v, (f.split() for f in fields.split(", ")))))
    declared = node("VAR_DECL", "INT", 0, 4, F.when(F.col("event_id") % 3 == 0, 3), None, False)
    reference = node("DECL_REF_EXPR", "INT", 9, None, None, F.when(F.col("event_id") % 4 == 0, "OVERLOADED_DECL_REF"), False)
    others = [node("PARM_DECL", "POINTER", 0, 5, None, None, False), node("CALL_EXPR", "INT", 0, 6, None, None, False), node("FIELD_DECL", "INT", 0, 7, None, None, True)]
    nodes = code.withColumn("n", F.explode(F.array(declared, declared, reference, *others))).select("event_id", "main", "text", "n.*")
    nodes = nodes.withColumn("file", F.when(F.col("elsewhere"), "header").otherwise(F.col("main")))
    return mutate.add_asterisk(nodes).select("event_id", F.col("at").alias("place"), "modified")


@query(f"SELECT event_id, mode, count(*) AS n FROM {PAIRS_SQL} GROUP BY ALL")
def variants_by_mode(spark, sf):
    """Variants through the table of modes, as a run asks for them by name."""
    return mutate.variants(_code(spark, sf), "remove_pair", "event_id").groupBy(F.col("id").alias("event_id"), "mode").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, unnest(['empty','by_value','by_reference','drop_first','prepend_reference','prepend_value','unknown','toggle']) AS mode,
 unnest(['[]','[=]','[&]', '[&' || b || ']', '[&, ' || a || ', &' || b || ']', '[=, ' || a || ', &' || b || ']', '[unknown]', '[&' || a || ', ' || b || ']']) AS capture
FROM (SELECT event_id, 'a' || user_id AS a, event_type AS b FROM events)""")
def mutate_lambda_capture(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr("concat('[a', user_id, ', &', event_type, ']')").alias("c"))
    return e.select("event_id", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), mutate.lambda_capture(F.col("c"), m).alias("capture")) for m in mutate.CAPTURES))).alias("v")).select("event_id", "v.*")


# ---- trees ----


def _nodes(spark, sf, version: int) -> DataFrame:
    """region -> nation -> customer as one tree; the second version renames, retypes, moves, adds and drops some."""
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    as_int = lambda x: F.col(x).cast("int")
    parts = [
        r.select(F.array(as_int("r_regionkey")).alias("path"), F.lit("REGION").alias("kind"), F.col("r_name").alias("spelling"), F.lit("").alias("type")),
        n.select(F.array(as_int("n_regionkey"), as_int("n_nationkey")).alias("path"), F.lit("NATION").alias("kind"), F.col("n_name").alias("spelling"), F.lit("").alias("type")),
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array(as_int("n_regionkey"), as_int("n_nationkey"), as_int("c_custkey")).alias("path"), F.lit("CUSTOMER").alias("kind"), F.col("c_name").alias("spelling"), F.col("c_mktsegment").alias("type")),
    ]
    out = reduce(DataFrame.unionByName, parts).withColumn("key", F.element_at("path", -1)).withColumn("location", F.concat(F.lit("f.c:"), F.col("key").cast("string")))
    if version == 2:
        out = out.where("NOT (kind = 'CUSTOMER' AND key % 10 = 3) AND NOT (size(path) >= 2 AND path[1] = 7)")
        out = out.withColumn("spelling", F.expr("CASE WHEN key % 4 = 1 THEN concat(spelling, 'x') ELSE concat('modified1_', spelling) END")).withColumn("type", F.expr("CASE WHEN kind = 'CUSTOMER' AND key % 5 = 0 THEN 'OTHER' ELSE type END"))
        out = out.withColumn("location", F.expr("CASE WHEN key % 6 = 2 THEN concat(location, '0') ELSE concat('modified1_', location) END")).withColumn("kind", F.expr("CASE WHEN kind = 'CUSTOMER' AND key % 7 = 4 THEN 'GUEST' ELSE kind END"))
        added = n.where("n_nationkey % 3 = 0").select(F.array(as_int("n_regionkey"), as_int("n_nationkey"), F.lit(9_000_000)).alias("path"), F.lit("CUSTOMER").alias("kind"), F.lit("new").alias("spelling"), F.lit("").alias("type"), F.lit(9_000_000).alias("key"), F.lit("f.c:0").alias("location"))
        out = out.unionByName(added)
    counts = out.where("size(path) > 1").groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.count(F.lit(1)).cast("int").alias("children"))
    return out.join(counts, "path", "left").select(F.lit(1).alias("tree_id"), "path", "kind", "spelling", "type", "location", F.coalesce("children", F.lit(0)).alias("children"))


TREE_SQL = """(SELECT concat(r_regionkey) AS path, '' AS up, 'REGION' AS kind, r_name AS spelling, '' AS type, r_regionkey AS key, -1 AS nation FROM region
UNION ALL SELECT concat_ws('.', n_regionkey, n_nationkey), concat(n_regionkey), 'NATION', n_name, '', n_nationkey, n_nationkey FROM nation
UNION ALL SELECT concat_ws('.', n_regionkey, n_nationkey, c_custkey), concat_ws('.', n_regionkey, n_nationkey), 'CUSTOMER', c_name, c_mktsegment, c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""
WITH t AS {TREE_SQL}, kept AS (SELECT * FROM t WHERE NOT (kind = 'CUSTOMER' AND key % 10 = 3) AND nation <> 7),
 sizes AS (SELECT path, (SELECT count(*) FROM t c WHERE c.up = t.path) AS before_n,
   (SELECT count(*) FROM kept c WHERE c.up = t.path) + CASE WHEN kind = 'NATION' AND key % 3 = 0 THEN 1 ELSE 0 END AS after_n FROM t WHERE kind <> 'CUSTOMER' AND nation <> 7)
SELECT path, 'name_changed' AS change FROM kept WHERE key % 4 = 1
UNION ALL SELECT path, 'type_changed' FROM kept WHERE kind = 'CUSTOMER' AND key % 5 = 0
UNION ALL SELECT path, 'position_changed' FROM kept WHERE key % 6 = 2
UNION ALL SELECT path, 'node_changed' FROM kept WHERE kind = 'CUSTOMER' AND key % 7 = 4
UNION ALL SELECT path, 'structure_change' FROM sizes WHERE before_n <> after_n
UNION ALL SELECT concat_ws('.', n_regionkey, n_nationkey, 9000000), 'node_added' FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT path, 'node_removed' FROM t WHERE (kind = 'NATION' AND nation = 7) OR (kind = 'CUSTOMER' AND nation <> 7 AND key % 10 = 3)
""")
def tree_diff(spark, sf):
    """All seven kinds of change."""
    return tree.diff(_nodes(spark, sf, 1), _nodes(spark, sf, 2)).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "change")


@query("""SELECT o_orderkey AS id, pos AS place, concat('KIND', k) AS node_kind, n FROM (
 SELECT o_orderkey, pos, max(l_linenumber) AS k, any_value(n) AS n FROM (
  SELECT o_orderkey, i AS pos, cast(1 AS BIGINT) AS n FROM (SELECT o_orderkey, unnest(list_filter(range(0, length(o_comment_like)), lambda i: o_comment_like[i + 1] IN (',', ':', '='))) AS i FROM (
   SELECT o_orderkey, concat(o_orderpriority, ':', cast(cast(o_orderdate AS DATE) AS VARCHAR), ',', o_orderstatus, '=', cast(o_custkey AS VARCHAR)) AS o_comment_like FROM orders)))
 LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber * 2 <= pos AND pos < l_linenumber * 2 + l_quantity GROUP BY 1, 2)""".replace("concat('KIND', k)", "CASE WHEN k IS NOT NULL THEN concat('KIND', k) END"))
def single_variants_with_kinds(spark, sf):
    """Variants of a line of each order, with the deepest of its items' ranges around each place."""
    line = F.concat_ws("", "o_orderpriority", F.lit(":"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(","), "o_orderstatus", F.lit("="), F.col("o_custkey").cast("string"))
    docs = table(spark, sf, "orders").select("o_orderkey", line.alias("text"))
    nodes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.sequence(F.lit(1), "l_linenumber").alias("path"), F.concat(F.lit("KIND"), F.col("l_linenumber").cast("string")).alias("kind"), (F.col("l_linenumber") * 2).alias("start"), (F.col("l_linenumber") * 2 + F.col("l_quantity")).cast("long").alias("end"))
    found = variants.placed(docs, "remove_single", "o_orderkey").where("mode in ('remove_comma', 'remove_colon', 'remove_equal')")
    return variants.with_kinds(found, nodes).groupBy("id", F.col("at").alias("place"), "node_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, count(*) AS n FROM {TREE_SQL} GROUP BY 1")
def node_kinds(spark, sf):
    return tree.kinds(_nodes(spark, sf, 1))


@query(f"SELECT path, repeat('  ', len(string_split(path, '.'))) || kind || ': ' || spelling AS line FROM {TREE_SQL}")
def tree_dump(spark, sf):
    out = tree.dump(_nodes(spark, sf, 1))
    return out.select(F.array_join(F.transform(F.split("place", r"\."), lambda x: x.cast("int").cast("string")), ".").alias("path"), "line")


@query("""SELECT o_orderkey, pos, arg_max(kind, depth) AS kind FROM (
 SELECT o_orderkey, pos, concat('LINE', l_linenumber) AS kind, l_linenumber AS depth FROM (SELECT o_orderkey, cast(floor(o_totalprice) % 50 AS BIGINT) AS pos FROM orders) JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber * 4 <= pos AND pos < l_linenumber * 4 + l_quantity) GROUP BY ALL""")
def node_at_offset(spark, sf):
    n = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.sequence(F.lit(1), "l_linenumber").alias("path"), F.concat(F.lit("LINE"), F.col("l_linenumber").cast("string")).alias("kind"), (F.col("l_linenumber") * 4).cast("long").alias("start"), (F.col("l_linenumber") * 4 + F.col("l_quantity")).cast("long").alias("end"))
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tree_id"), F.expr("cast(floor(o_totalprice) % 50 as bigint)").alias("offset"))
    return tree.node_at(n, at, 64).select(F.col("tree_id").alias("o_orderkey"), F.col("offset").alias("pos"), "kind")


@query(f"""SELECT event_id, side, CASE side WHEN 'left' THEN 4 + strpos(substr(text, 5, 60), '(') - 1 ELSE 4 + length(substr(text, 5, 60)) - strpos(reverse(substr(text, 5, 60)), ')') END AS pos
 FROM {CODE_SQL}, (SELECT unnest(['left', 'right']) AS side) WHERE event_id % 3 <> 1""")
def parentheses_of_calls(spark, sf):
    """A call from place 4 to 64 in each text; every third node is of another kind."""
    kind = F.when(F.col("event_id") % 3 == 1, "IF_STMT").otherwise("CALL_EXPR")
    nodes = _code(spark, sf).select(F.col("event_id").alias("tree_id"), F.array(F.lit(0)).alias("path"), kind.alias("kind"), F.lit("m").alias("file"), F.lit("m").alias("main"), "text", F.lit(4).alias("start"), F.lit(64).alias("end"))
    return tree.parentheses(nodes).select(F.col("tree_id").alias("event_id"), "side", "pos")


@query("SELECT l_orderkey, arg_min(concat('n', l_partkey), {'a': l_linenumber, 'b': concat('n', l_partkey)}) AS spelling, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def first_identifier(spark, sf):
    tokens = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.array(F.lit(0)).alias("path"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") != "N", "IDENTIFIER").otherwise("PUNCTUATION").alias("kind"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("spelling"))
    return tree.first_identifiers(tokens).select(F.col("tree_id").alias("l_orderkey"), "spelling", "pos")


@query("""SELECT event_id, user_id % 40 AS col, CASE WHEN user_id % 40 >= 30 THEN NULL WHEN user_id % 40 >= 10 AND user_id % 40 <= 19 AND event_id % 4 < 2 THEN 'CALL_EXPR' ELSE 'FUNCTION_DECL' END AS kind FROM events WHERE event_id % 5 <> 0""")
def parenthesis_owner(spark, sf):
    """A function in columns 0 to 29, in it a call or reference in 10 to 19, in that an unexposed expression; every fifth place is no parenthesis.

    A second child over the same columns, and one that holds a place below a node that does not, are never reached.
    """
    e = table(spark, sf, "events")
    node = lambda path, kind, a, b: F.struct(F.array(*map(F.lit, path)).alias("path"), kind.alias("kind"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"), F.lit(a).alias("col_start"), F.lit(b).alias("col_end"))
    inner = F.when(F.col("event_id") % 4 < 2, "CALL_EXPR").otherwise("DECL_REF_EXPR")
    nodes = e.select(F.col("event_id").alias("tree_id"), F.explode(F.array(node([0], F.lit("FUNCTION_DECL"), 0, 29), node([0, 1], inner, 10, 19), node([0, 1, 0], F.lit("UNEXPOSED_EXPR"), 12, 15), node([0, 2], F.lit("IF_STMT"), 10, 19), node([0, 3], F.lit("IF_STMT"), 90, 99), node([0, 3, 0], F.lit("FOR_STMT"), 20, 25))).alias("n")).select("tree_id", "n.*")
    places = e.select(F.col("event_id").alias("tree_id"), F.lit(2).alias("line"), (F.col("user_id") % 40).alias("col"), F.when(F.col("event_id") % 5 == 0, ";").otherwise(F.when(F.col("event_id") % 2 == 0, "(").otherwise(")")).alias("symbol"))
    return tree.parenthesis_owner(nodes, places).select(F.col("tree_id").alias("event_id"), "col", "kind")


# ---- many offsets, encodings, long logs, modes in SQL ----


@query("SELECT doc_id, k, len(string_split(left(text, o), chr(10))) AS line_no, md5(string_split(text, chr(10))[len(string_split(left(text, o), chr(10)))]) AS line_md5 FROM (SELECT doc_id, text, k, cast(length(text) * k // 20 AS INT) AS o FROM documents, (SELECT unnest(range(20)) AS k) WHERE text IS NOT NULL AND NOT contains(text, chr(92)))")
def lines_of_offsets(spark, sf):
    """Twenty places of each text, looked up in one list of its lines."""
    d = table(spark, sf, "documents").where(F.col("text").isNotNull() & ~F.col("text").contains("\\"))
    offsets = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.floor(F.char_length("text").cast("long") * k / 20))
    found = d.select("doc_id", "text", text.line_spans(F.col("text"), offsets).alias("s"))
    lines = F.arrays_zip(F.col("s.number").alias("n"), text.span_lines(F.col("text"), F.col("s")).alias("l"))
    return found.select("doc_id", F.posexplode(lines).alias("k", "x")).select("doc_id", F.col("k").cast("long").alias("k"), F.col("x.n").alias("line_no"), F.md5("x.l").alias("line_md5"))


@query(r"""SELECT doc_id, md5(t) AS text_md5, CASE WHEN t = '' THEN 'ascii' WHEN doc_id % 4 = 0 THEN 'utf-16-le' WHEN doc_id % 4 = 1 THEN 'utf-16' WHEN regexp_full_match(t, '[\x{00}-\x{7f}]*') THEN 'ascii' WHEN doc_id % 4 = 2 AND regexp_full_match(t, '[\x{00}-\x{7f}\x{a0}-\x{ff}]*') THEN 'latin-1' ELSE 'utf-8' END AS encoding
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE length(t) <> 0""")
def decode_sources(spark, sf):
    """Each text in one of four encodings, with or without a mark, read by what its bytes tell."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where("t <> ''")
    latin = (F.col("doc_id") % 4 == 2) & F.col("t").rlike(r"^[\x00-\x7f\xa0-\xff]*$")
    raw = F.when(F.col("doc_id") % 4 == 0, F.encode("t", "UTF-16LE")).when(F.col("doc_id") % 4 == 1, F.encode("t", "UTF-16")).when(latin, F.encode(F.when(latin, F.col("t")), "ISO-8859-1")).otherwise(F.encode("t", "UTF-8"))
    found = d.select("doc_id", encodings.decoded(raw).alias("d"))
    return found.select("doc_id", F.md5("d.text").alias("text_md5"), F.col("d.encoding").alias("encoding"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, md5(coalesce(text, '')) AS message_md5 FROM documents WHERE doc_id IS NOT NULL")
def attempt_entries(spark, sf):
    """The documents as entries of long log files, read by byte ranges."""
    import uuid

    path = f"{inputs.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    head = F.concat(F.lit("2024-11-18 10:00:00,"), F.col("doc_id").cast("string"), F.lit(" - "), F.when(F.col("doc_id") % 3 == 0, "ERROR").otherwise("INFO"), F.lit(" - "))
    table(spark, sf, "documents").where("doc_id is not null").select(F.concat(head, F.coalesce("text", F.lit(""))).alias("value")).write.option("lineSep", "\n").text(path)
    found = logs.read_attempts_in_blocks(spark, path)
    return found.select(F.substring_index("time", ",", -1).cast("long").alias("doc_id"), "level", F.md5("message").alias("message_md5"))


_NINE = ", ".join(f"('{old}', '{new}', '{mode}')" for (old, new), mode in mutate.REPLACE_MODES.items())


@query(f"SELECT doc_id, mode, md5(line) AS line_md5, md5(substr(line, 1, pos) || new || substr(line, pos + 1 + length(old))) AS modified_md5 FROM {_places(':;,=')} JOIN (VALUES {_NINE}) AS t(old, new, mode) ON substr(line, pos + 1, length(old)) = old")
def variants_lateral(spark, sf):
    """The nine replacements of every document by the table function, in SQL."""
    variants.register(spark)
    docs = table(spark, sf, "documents")
    return spark.sql("SELECT d.doc_id, v.mode, md5(v.line) AS line_md5, md5(v.modified) AS modified_md5 FROM {docs} d, LATERAL variants(d.text, 'replace_all', 0) v", docs=docs)


@query()
def pair_variants_of_pages(spark, sf):
    """All pairs of brackets in whole pages and documents, nested ones too; per text and mode how many and how long their lines are."""
    pages = table(spark, sf, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = table(spark, sf, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text")
    found = [mutate.remove_pairs(t, "id", "text").withColumn("source", F.lit(name)) for name, t in (("page", pages), ("document", docs))]
    return found[0].unionByName(found[1]).groupBy("source", "id", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("modified")).alias("chars"), F.max(F.col("end") - F.col("start")).alias("widest"))


# ---- streaming ----


@query(f"SELECT coalesce(name, 'not_found') AS name, count(*) AS n FROM (SELECT e.event_id, arg_min(r.name, r.ord) AS name FROM {MESSAGES_SQL} e LEFT JOIN {RULES_SQL.replace('AS rules(', 'AS r(')} ON r.pattern <> '.*' AND regexp_matches(e.message, '^(?:' || r.pattern || ')') GROUP BY e.event_id) GROUP BY 1")
def stream_label_counts(spark, sf):
    import uuid

    from ..streaming import ingest

    base = f"{inputs.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    inputs.messages(spark, sf).select("message").write.parquet(f"{base}/in")
    stream = ingest.stream_log(spark, f"{base}/in", "message string", "parquet")
    ingest.run_available(ingest.label_counts(stream, RULES), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


@query(SQL["attempts_until_success"])
def stream_attempts(spark, sf):
    """``attempts_until_success`` as a stream: the rows come in two parts, the query starts anew for each on one checkpoint."""
    import uuid

    from ..streaming import ingest

    base = f"{inputs.shared_dir(spark)}/attempts-{uuid.uuid4().hex}"
    place = F.coalesce("l_orderkey", F.lit(2**59)) * 10 + F.coalesce("l_linenumber", F.lit(9))  # nulls last
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), place.alias("place"), (F.col("l_quantity") > 44).alias("small"), (F.col("l_discount") > 0.07).alias("large"))
    buckets = max(1, rows.count() // 20_000)
    before = spark.conf.get(ingest.ROCKSDB[0], None)
    spark.conf.set(*ingest.ROCKSDB)
    try:
        for part in range(2):
            rows.where(F.pmod(F.xxhash64("place"), F.lit(2)) == part).write.mode("append").parquet(f"{base}/in")
            ingest.collect_updates(ingest.attempts(ingest.stream_log(spark, f"{base}/in", "key long, place long, small boolean, large boolean", "parquet"), buckets=buckets), f"{base}/out", f"{base}/state")
    finally:
        spark.conf.unset(ingest.ROCKSDB[0]) if before is None else spark.conf.set(ingest.ROCKSDB[0], before)
    return ingest.latest(spark.read.parquet(f"{base}/out")).withColumnRenamed("key", "l_partkey")
