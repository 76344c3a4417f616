"""Classification of messages by rules: first match in rule order, or all matches.

Messages are made distinct before matching.  Few rules become one expression of constant patterns
(compiled once, tried in order, no join).  Many rules go to Arrow batches behind an index: the longest text
that every match of a rule holds is put into one automaton, so a message is read once, and only rules whose
text is in it are tried, in rule order.  A pattern is matched at the message's start; ``.`` excludes newlines
only.  Rules whose pattern is exactly ``.*`` are skipped; rules that do not compile are dropped up front, by
the engine that runs them: a short list with a pattern that only Python accepts goes to the batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import is_valid

FEW = 64
Rule = tuple[str, str]  # name, pattern; order is precedence
NOT_FOUND = "not_found"


def usable(rules: list[Rule]) -> list[Rule]:
    return [(n, p) for n, p in rules if p != ".*" and is_valid(p)]


def runs_in_jvm(pattern: str) -> bool:
    """Whether the engine of column expressions accepts the pattern as it is used there."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(f"^(?d:{pattern})")
    except IllegalArgumentException:
        return False
    return True


def _hit(message: Column, pattern: str) -> Column:
    return message.rlike(f"^(?d:{pattern})")


def first_label(message: Column, rules: list[Rule]) -> Column:
    """The first rule's name as an expression; rules that do not compile there are left out."""
    return F.coalesce(*(F.when(_hit(message, p), F.lit(n)) for n, p in usable(rules) if runs_in_jvm(p)), F.lit(None).cast("string"))


def all_labels(message: Column, rules: list[Rule]) -> Column:
    """Array of labels in rule order; null where none matches."""
    found = F.filter(F.array(*(F.when(_hit(message, p), F.lit(n)) for n, p in usable(rules) if runs_in_jvm(p)), F.lit(None).cast("string")), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


# ---- index of long lists ----


def held_text(pattern: str) -> str:
    """The longest text that every match of the pattern holds, as far as it can be told outside groups; empty if unknown."""
    best, run, depth, i = "", "", 0, 0
    while i < len(pattern):
        c, literal, start = pattern[i], None, i
        if c == "\\" and i + 1 < len(pattern):
            literal = pattern[i + 1] if not pattern[i + 1].isalnum() else None
            i += 2
        elif c == "[":  # a class: up to its closing bracket, which may come first
            i = i + 2 + (pattern[i + 1 : i + 2] == "^")
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        else:
            i += 1
            if c == "(":
                if pattern.startswith("(?", start) and not pattern.startswith(("(?:", "(?P<", "(?=", "(?!", "(?<"), start):
                    return ""  # flags may change what a letter means
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == "|" and depth == 0:
                return ""
            elif c not in ".^$*+?{}|":
                literal = c
            elif c in "{}" and not re.match(r"\{\d*,?\d*\}", pattern[start:]):
                literal = c
        repeat = re.compile(r"[*?]|\{\d*,?\d*\}|\+").match(pattern, i)
        if literal is None or depth > 0 or repeat:
            if literal is not None and depth == 0 and repeat and repeat.group() == "+":
                run += literal
            best, run = max(best, run, key=len), ""
            if repeat:
                i = repeat.end()
                while i < len(pattern) and pattern[i] in "?+":
                    i += 1
        else:
            run += literal
    return max(best, run, key=len)


class RuleIndex:
    """Rules by the text they hold; those without one are candidates of every message."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = [(n, re.compile(p)) for n, p in rules]
        self.always: list[int] = []
        by_text: dict[str, list[int]] = {}
        for i, (_, p) in enumerate(rules):
            text = held_text(p)
            by_text.setdefault(text, []).append(i) if text else self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for text, places in by_text.items():
            self.automaton.add_word(text, places)
        if by_text:
            self.automaton.make_automaton()

    def candidates(self, message: str) -> list[int]:
        """Places of the rules to try, in rule order."""
        found = set(self.always)
        if len(self.automaton):
            for _, places in self.automaton.iter(message):
                found.update(places)
        return sorted(found)

    def first(self, message: str, places: list[int]) -> str | None:
        return next((self.rules[i][0] for i in places if self.rules[i][1].match(message)), None)

    def every(self, message: str, places: list[int]) -> list[str] | None:
        return [self.rules[i][0] for i in places if self.rules[i][1].match(message)] or None


def match_indexed(messages: DataFrame, rules: list[Rule], every: bool) -> DataFrame:
    """Adds name or names, and n_candidates (rules that were tried at most), to rows with a ``message``; null has neither."""
    kept = usable(rules)
    column = "names" if every else "name"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(kept)
        find = index.every if every else index.first
        for b in batches:
            places = [index.candidates(m) if m is not None else [] for m in b["message"]]
            yield b.assign(**{column: [find(m, p) if p else None for m, p in zip(b["message"], places)], "n_candidates": [len(p) for p in places]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    return messages.mapInPandas(run, f"{schema}, {column} {'array<string>' if every else 'string'}, n_candidates int")


def match_distinct(messages: DataFrame, rules: list[Rule], every: bool, few: int = FEW) -> DataFrame:
    """messages: message.  One row per distinct message: message, n (rows), name or names."""
    counted = messages.groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    if len(rules) <= few and all(runs_in_jvm(p) for _, p in usable(rules)):
        return counted.withColumn("names" if every else "name", (all_labels if every else first_label)(F.col("message"), rules))
    return match_indexed(counted, rules, every).drop("n_candidates")


def label_counts(matched: DataFrame) -> DataFrame:
    """Counts per label of ``match_distinct``'s rows, ``not_found`` always among them."""
    if "names" in matched.columns:
        matched = matched.select("n", F.explode_outer("names").alias("name"))
    zero = matched.sparkSession.createDataFrame([(NOT_FOUND, 0)], "name string, n long")
    rows = matched.select(F.coalesce("name", F.lit(NOT_FOUND)).alias("name"), "n").unionByName(zero)
    return rows.groupBy("name").agg(F.sum("n").alias("n"))


def unmatched(matched: DataFrame) -> DataFrame:
    """Messages without a label, as often as they came: no second pass over the messages."""
    column = "names" if "names" in matched.columns else "name"
    return matched.where(F.col(column).isNull()).select("message", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).select("message")
