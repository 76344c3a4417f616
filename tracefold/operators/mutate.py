"""Source variants: one row per place.

A variant of a line is (line number, place in the line, original line, modified line); ``apply_variant`` puts
the line back into a whole text.  Places are found by splitting the line at the symbol, so work per line is its
length for each place.  Variants of pairs and of declarations know their place in the text; their lines run over
backslash continuations.  Every variant has the name of its mode.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commands import remove_some, seeded_order
from ..functions.text import line_at_offset
from .tree import node_at

#: Symbols that are deleted one at a time, replacements and pairs, each with its mode.
SINGLE_MODES = {
    ":": "remove_colon",
    ";": "remove_semicolon",
    ",": "remove_comma",
    ".": "remove_dot",
    "*": "remove_asterisk",
    "&": "remove_ampersand",
    "!": "remove_exclamation",
    "=": "remove_equal",
    "+": "remove_plus",
    "-": "remove_minus",
    "/": "remove_slash",
    "%": "remove_percent",
    "<": "remove_less",
    ">": "remove_greater",
    "^": "remove_caret",
    "|": "remove_pipe",
    "~": "remove_tilde",
    "?": "remove_question",
}
REPLACE_MODES = {
    (":", "::"): "replace_colon_with_double_colon",
    ("::", ":"): "replace_double_colon_with_colon",
    (":", ";"): "replace_colon_with_semicolon",
    (":", ","): "replace_colon_with_comma",
    (";", ":"): "replace_semicolon_with_colon",
    (";", ","): "replace_semicolon_with_comma",
    (",", ":"): "replace_comma_with_colon",
    ("=", "=="): "replace_equal_with_double_equal",
    ("==", "="): "replace_double_equal_with_equal",
}
PAIR_MODES = {"(": "remove_parentheses", "[": "remove_brackets", "{": "remove_braces", "<": "remove_angle"}
SINGLES = "".join(SINGLE_MODES)
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
CAPTURES = ("empty", "by_value", "by_reference", "drop_first", "prepend_reference", "prepend_value", "unknown", "toggle")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))


def replace_mode(old: str, new: str) -> str:
    if (old, new) not in REPLACE_MODES:
        raise ValueError(f"Unknown symbol: {old}, {new}")
    return REPLACE_MODES[old, new]


def _places(rows: DataFrame, symbols: str) -> DataFrame:
    """A row for each place ``at`` of one of ``symbols`` in ``line``; ``parts`` are the pieces between them, ``k`` counts from 1."""
    one_of = "[" + "".join("\\" + c for c in symbols) + "]"
    cut = rows.where(F.col("line").rlike(one_of)).withColumn("parts", F.split("line", one_of, -1)).withColumn("sizes", F.transform("parts", F.char_length))
    each = cut.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)))
    return each.withColumn("at", F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.col("k") - 1, lambda x, n: x + n)).drop("sizes")


def replace_symbol(rows: DataFrame, old: str, new: str) -> DataFrame:
    """A variant for each place of ``old``, a character or one twice (overlapping places too), in ``line``."""
    if not old or set(old) != {old[0]} or len(old) > 2:
        raise ValueError(f"Unknown symbol: {old}")
    places = _places(rows, old[0])
    if len(old) == 2:  # the next one follows at once
        places = places.where((F.get("parts", F.col("k")) == "") & (F.col("k") < F.size("parts") - 1))
    return places.drop("parts", "k").withColumn("modified", F.concat(F.expr("substr(line, 1, at)"), F.lit(new), F.expr(f"substr(line, at + {len(old) + 1})")))


def replace_all(rows: DataFrame) -> DataFrame:
    """The variants of all nine replacements, with ``mode``."""
    return reduce(DataFrame.unionByName, [replace_symbol(rows, old, new).withColumn("mode", F.lit(mode)) for (old, new), mode in REPLACE_MODES.items()])


def delete_symbols(rows: DataFrame, symbols: str = SINGLES) -> DataFrame:
    """A variant for each place of one of ``symbols``, with ``symbol`` and, for those that have one, ``mode``."""
    places = _places(rows, symbols).drop("parts", "k").withColumn("symbol", F.expr("substr(line, at + 1, 1)"))
    modes = F.create_map(*(F.lit(x) for kv in SINGLE_MODES.items() for x in kv))
    return places.withColumn("mode", F.element_at(modes, F.col("symbol"))).withColumn("modified", F.concat(F.expr("substr(line, 1, at)"), F.expr("substr(line, at + 2)")))


def sample_per_group(variants: DataFrame, keys: list[str], order: Column, k: int) -> DataFrame:
    """k variants of each group in the order of a digest; each task sends k of a group at most."""
    return variants.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_at") <= k).drop("_at")


def distinct_places(variants: DataFrame, keys: list[str]) -> DataFrame:
    return variants.dropDuplicates(keys)


def bracket_pairs(text: str, pairs: dict[str, str]) -> list[tuple[int, int]]:
    """Matched places of each kind of bracket, by a stack per kind."""
    out: list[tuple[int, int]] = []
    stacks: dict[str, list[int]] = {c: [] for c in pairs.values()}
    for m in re.finditer("[" + re.escape("".join([*pairs, *pairs.values()])) + "]", text):
        c = m.group()
        if c in pairs:
            stacks[pairs[c]].append(m.start())
        elif stacks[c]:
            out.append((stacks[c].pop(), m.start()))
    return sorted(out)


def line_at(text: str, offset: int) -> str:
    """The line of a 0-based offset with the continuations that follow it."""
    start, end = text.rfind("\n", 0, offset) + 1, text.find("\n", offset)
    while end > 0 and text[end - 1] == "\\":
        end = text.find("\n", end + 1)
    return text[start:] if end < 0 else text[start:end]


def without_pair(text: str, start: int, end: int) -> str:
    """The line at ``start`` once the characters at both places are gone; costs that line, not the text."""
    out, before = [text[text.rfind("\n", 0, start) + 1 : start]], text[start - 1] if start else ""
    for a, b in ((start + 1, end), (end + 1, len(text))):
        at = text.find("\n", a, b)
        while at >= 0 and (text[at - 1] if at > a else before) == "\\":  # the next line continues it
            at = text.find("\n", at + 1, b)
        if at >= 0:
            return "".join(out) + text[a:at]
        out.append(text[a:b])
        before = text[b - 1] if b > a else before
    return "".join(out)


def remove_pairs(docs: DataFrame, id_col: str, text_col: str, pairs: dict[str, str] = PAIRS) -> DataFrame:
    """A variant per matched pair, nested ones too: id, mode, start, end, line, modified.

    ``line`` and ``modified`` are the line at the pair's start before and after both ends are gone.  Nesting needs a stack: Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "mode", "start", "end", "line", "modified"]
        for b in batches:
            rows, size = [], 0
            for i, t in zip(b["id"], b["text"]):
                for s, e in bracket_pairs(t, pairs) if t else ():
                    rows.append((i, PAIR_MODES.get(t[s], "remove_pair"), s, e, line_at(t, s), without_pair(t, s, e)))
                    size += 2 * len(rows[-1][-1]) + 100
                    if size > 4_000_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, mode string, start long, end long, line string, modified string")


def remove_parentheses(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """The variants of all pairs of parentheses but those whose first one is a loop's own: its deepest node is FOR_STMT.

    nodes: tree_id (the text's identifier), path, kind, start, end; if they have file and main, those of other files than main are left out,
    as their places are in another text.  Adds node_kind, null outside all nodes.
    """
    if {"file", "main"} <= set(nodes.columns):
        nodes = nodes.where("file = main")
    found = remove_pairs(docs, id_col, text_col, {"(": ")"})
    kinds = node_at(nodes, found.select(F.col("id").alias("tree_id"), F.col("start").alias("offset"))).select(F.col("tree_id").alias("id"), F.col("offset").alias("start"), F.col("kind").alias("node_kind"))
    return found.join(kinds, ["id", "start"], "left").where("node_kind is null or node_kind <> 'FOR_STMT'")


def lambda_capture(c: Column, mode: str) -> Column:
    """A capture list such as ``[a, &b]`` in one of the modes of ``CAPTURES``."""
    body = F.trim(F.regexp_extract(c, r"^\[([^\]]*)\]$", 1))
    items = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x != "")
    wrap = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    return {
        "empty": F.lit("[]"),
        "by_value": F.lit("[=]"),
        "by_reference": F.lit("[&]"),
        "drop_first": wrap(F.array_join(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), ", ")),
        "prepend_reference": wrap(F.concat(F.lit("&, "), body)),
        "prepend_value": wrap(F.concat(F.lit("=, "), body)),
        "unknown": F.lit("[unknown]"),
        "toggle": wrap(F.array_join(F.transform(items, lambda x: F.when(x.startswith("&"), F.substring(x, F.lit(2), F.char_length(x))).otherwise(F.concat(F.lit("&"), x))), ", ")),
    }[mode]


def add_asterisk(nodes: DataFrame, main: str = "main") -> DataFrame:
    """A variant for each declaration or reference that is no pointer: an asterisk before its name, or after the type it refers to.

    nodes: file, ``main`` (the file that is changed; nodes of others are left out), text, kind, type_kind, start, name_start
    (first identifier) and type_ref_end (of the first TYPE_REF child), null if there is none, referenced_kind.  Adds at, line, modified.
    """
    declares = F.col("kind").isin("VAR_DECL", "PARM_DECL", "FIELD_DECL")
    eligible = (declares | (F.col("kind") == "DECL_REF_EXPR")) & (F.col("type_kind") != "POINTER") & (F.col("file") == F.col(main)) & ~F.col("referenced_kind").eqNullSafe("OVERLOADED_DECL_REF")
    at = F.when(declares, F.coalesce("type_ref_end", "name_start", "start")).otherwise(F.col("start"))
    placed = nodes.where(eligible).withColumn("at", at.cast("int")).dropDuplicates(["file", "at"])
    changed = F.concat(F.expr("substr(text, 1, at)"), F.lit("*"), F.expr("substr(text, at + 1)"))
    return placed.withColumn("line", line_at_offset(F.col("text"), F.col("at"))).withColumn("modified", line_at_offset(changed, F.col("at")))


def _of_lines(change):
    return lambda docs, id_col, text_col: change(lines(docs, id_col, text_col)).select(F.col(id_col).alias("id"), "mode", "line", "modified")


def _captures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each capture list of a text in each mode."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\[[^\[\]]*\]"), F.lit(0))).alias("line"))
    forms = F.array(*(F.struct(F.lit(m).alias("mode"), lambda_capture(F.col("line"), m).alias("modified")) for m in CAPTURES))
    return found.withColumn("v", F.explode(forms)).select("id", "v.mode", "line", "v.modified")


def _arguments(mode: str, change) -> Callable:
    """Of a command in the text column; its identifier is the seed."""

    def run(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        argv = F.filter(F.split(F.col(text_col), r"\s+"), lambda a: a != "")
        return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lit(mode).alias("mode"), F.col(text_col).alias("line"), F.array_join(change(argv, F.col(id_col)), " ").alias("modified"))

    return run


#: Modes of sources and arguments and what makes their variants: id, mode, line, modified.
DISPATCH = {
    "remove_parentheses": lambda docs, i, t: remove_pairs(docs, i, t, {"(": ")"}).select("id", "mode", "line", "modified"),
    "replace_colon_with_semicolon": _of_lines(lambda rows: replace_symbol(rows, ":", ";").withColumn("mode", F.lit("replace_colon_with_semicolon"))),
    "replace_all": _of_lines(replace_all),
    "remove_single": _of_lines(delete_symbols),
    "remove_pair": lambda docs, i, t: remove_pairs(docs, i, t).select("id", "mode", "line", "modified"),
    "lambda_captures": _captures,
    "argsreorder": _arguments("argsreorder", lambda argv, seed: seeded_order(argv, seed)),
    "argsremove": _arguments("argsremove", lambda argv, seed: remove_some(argv, seed, 4)),
}


def variants(docs: DataFrame, mode: str, id_col: str = "doc_id", text_col: str = "text", nodes: DataFrame | None = None) -> DataFrame:
    """All variants of a mode: id, mode, line, modified.  add_asterisk_to_variables takes its places from ``nodes`` (see ``add_asterisk``), which name their text in ``id_col``."""
    if mode == "add_asterisk_to_variables" and nodes is not None:
        return add_asterisk(nodes).select(F.col(id_col).alias("id"), F.lit(mode).alias("mode"), "line", "modified")
    if mode not in DISPATCH:
        raise ValueError(f"mode: {mode!r}")
    return DISPATCH[mode](docs, id_col, text_col)


def apply_variant(text: Column, line_no: Column, modified: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.when(i == line_no, modified).otherwise(x)), "\n")
