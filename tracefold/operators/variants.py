"""Source and argument variants of one text by mode, as a table function for SQL.

``register(spark)`` makes ``variants(text, mode, seed)`` known: ``SELECT d.doc_id, v.* FROM docs d, LATERAL variants(d.text, 'remove_pair', 0) v``.
A mode is a function from a text and a seed to (place, line, modified line); ``MODES`` has those of the engine, and
``register`` takes more by name.  Modes whose places need a syntax tree take them with the text: see ``with_nodes``.
A null text has no variants; a mode that is not known is an error.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.commands import PROTECTED
from .mutate import PAIR_MODES, PAIRS, REPLACE_MODES, SINGLE_MODES, SINGLES, bracket_pairs, line_at, without_pair
from .tree import add_kinds

Variant = tuple[str, int, str, str]  # mode, place in the text, line, modified line
Mode = Callable[[str, int], Iterator[Variant]]
_SINGLE = re.compile(f"[{re.escape(SINGLES)}]")
_CAPTURE = re.compile(r"\[([^\[\]]*)\]")


def _lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def _replaced(old: str, new: str) -> Mode:
    def run(text: str, seed: int) -> Iterator[Variant]:
        for start, line in _lines(text):
            i = line.find(old)
            while i >= 0:
                yield REPLACE_MODES[old, new], start + i, line, line[:i] + new + line[i + len(old) :]
                i = line.find(old, i + 1)

    return run


def _singles(text: str, seed: int) -> Iterator[Variant]:
    for start, line in _lines(text):
        for m in _SINGLE.finditer(line):
            yield SINGLE_MODES[m.group()], start + m.start(), line, line[: m.start()] + line[m.end() :]


def _pairs(kinds: dict[str, str]) -> Mode:
    def run(text: str, seed: int) -> Iterator[Variant]:
        for s, e in bracket_pairs(text, kinds):
            yield PAIR_MODES[text[s]], s, line_at(text, s), without_pair(text, s, e)

    return run


def _all_replaced(text: str, seed: int) -> Iterator[Variant]:
    for old, new in REPLACE_MODES:
        yield from _replaced(old, new)(text, seed)


def _captures(text: str, seed: int) -> Iterator[Variant]:
    for m in _CAPTURE.finditer(text):
        body = m.group(1).strip(" ")
        items = [x for x in (x.strip(" ") for x in body.split(",")) if x]
        toggled = ", ".join(x[1:] if x.startswith("&") else "&" + x for x in items)
        forms = {"empty": "", "by_value": "=", "by_reference": "&", "drop_first": ", ".join(items[1:]), "prepend_reference": f"&, {body}", "prepend_value": f"=, {body}", "unknown": "unknown", "toggle": toggled}
        for mode, form in forms.items():
            yield mode, m.start(), m.group(), f"[{form}]"


def _order(arguments: list[str], seed: int) -> list[str]:
    """A shuffle that repeats: by digest of seed, place and text."""
    return [a for _, a in sorted((hashlib.md5(f"{seed}|{i}|{a}".encode()).hexdigest(), a) for i, a in enumerate(arguments))]


def _reordered(text: str, seed: int) -> Iterator[Variant]:
    yield "argsreorder", 0, text, " ".join(_order(text.split(), seed))


def _removed(text: str, seed: int) -> Iterator[Variant]:
    """One to all but one of the arguments go, but for protected ones."""
    arguments = text.split()
    drawn = _order(arguments, seed)[: random.Random(seed).randint(1, max(1, len(arguments) - 1))]
    gone = {a for a in drawn if not a.startswith(PROTECTED)}
    yield "argsremove", 0, text, " ".join(a for a in arguments if a not in gone)


def _asterisks(text: str, seed: int) -> Iterator[Variant]:
    """``text`` is what ``with_nodes`` makes: places are those of eligible declarations and references, each once."""
    given = json.loads(text)
    source = given["text"]
    for at in sorted(set(given["places"])):
        line = line_at(source, at)
        inside = at - source.rfind("\n", 0, at) - 1
        yield "add_asterisk_to_variables", at, line, line[:inside] + "*" + line[inside:]


def with_nodes(text: str, places: list[int]) -> str:
    """The text that the mode add_asterisk_to_variables takes, and ``to_json(struct(text, places))`` in SQL."""
    return json.dumps({"text": text, "places": places})


MODES: dict[str, Mode] = {
    "argsreorder": _reordered,
    "argsremove": _removed,
    "remove_parentheses": _pairs({"(": ")"}),
    "replace_colon_with_semicolon": _replaced(":", ";"),
    "add_asterisk_to_variables": _asterisks,
    "replace_all": _all_replaced,
    "remove_single": _singles,
    "remove_pair": _pairs(PAIRS),
    "lambda_captures": _captures,
}


def placed(docs: DataFrame, mode: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The variants of a mode over a table: id, mode, at (place in the text), line, modified."""
    make = MODES[mode]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = ((i, *v) for i, t in zip(b["id"], b["text"]) if t for v in make(t, seed))
            while rows := list(islice(found, 5000)):
                yield pd.DataFrame(rows, columns=["id", "mode", "at", "line", "modified"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, mode string, at long, line string, modified string")


def with_kinds(variants: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds node_kind: that of the deepest node around each variant's place, null if none.  nodes: tree_id (the text), path, kind, start, end."""
    return add_kinds(nodes, variants.select("id", "at", *(c for c in variants.columns if c not in ("id", "at"))), "id", "at")


def register(spark: SparkSession, more: dict[str, Mode] | None = None, name: str = "variants") -> None:
    """Make the table function known to a session, with the modes of ``MODES`` and ``more``."""
    modes = MODES | (more or {})

    class Variants:
        def eval(self, text: str, mode: str, seed: int):
            if mode not in modes:
                raise ValueError(f"mode: {mode!r}")
            if text is not None:
                yield from modes[mode](text, seed or 0)

    spark.udtf.register(name, udtf(Variants, returnType="mode string, at int, line string, modified string"))
