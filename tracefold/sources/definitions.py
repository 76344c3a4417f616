"""Diagnostic definition files: records with severity and group, groups of warnings, and the rule catalogue.

A file is cut into tokens (comments, strings, blocks of code, words, brackets), so brackets and commas in strings
or comments end nothing.  A record is ``def NAME : PARENT<ARGUMENTS>, PARENT<ARGUMENTS> ... ;`` or with a body in
braces.  The first parent whose arguments begin with a string is its kind; strings that follow each other
are one.  The others say how severe it is and which group it belongs to.  Files are parsed in Arrow batches, a file
at a time; what cannot be read as a record is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.templates import Compiler, is_valid, strip_summary

RULE_KINDS = ("Error", "ExtWarn")
#: The severity that a kind of diagnostic starts with, and what changes it.
SEVERITY = {"Note": "note", "Remark": "ignored", "Warning": "warning", "Extension": "ignored", "ExtWarn": "warning", "Error": "error"}
CHANGES = {"DefaultIgnore": "ignored", "DefaultRemark": "remark", "DefaultWarn": "warning", "DefaultError": "error", "DefaultFatal": "fatal"}
SCHEMA = "rule_ord long, file string, pos int, name string, kind string, summary string, pattern string, valid boolean"
RECORDS = "file string, pos int, name string, kind string, summary string, raw string, severity string, group_name string, flag string, mixins array<string>"
FLAGGED = "file string, pos int, name string, group_name string, flag string, subgroups array<string>"
GROUPS = "file string, pos int, name string, flag string, subgroups array<string>"
_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<code>\[\{.*?\}\])|(?P<word>[\w.#]+)|(?P<mark>.)', re.DOTALL)
_OPEN = {"<": ">", "[": "]", "{": "}", "(": ")"}


@dataclass
class Parent:
    name: str
    start: int = 0  # of the arguments in the text
    end: int = 0
    tokens: list[tuple[str, str]] = field(default_factory=list)

    def strings(self) -> list[str]:
        """The strings the arguments begin with."""
        out = []
        for kind, text in self.tokens:
            if kind != "string":
                break
            out.append(text[1:-1])
        return out


@dataclass
class Record:
    pos: int
    name: str
    parents: list[Parent]


def _tokens(text: str) -> list[tuple[str, str, int]]:
    return [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]


def records_of(text: str) -> list[Record]:
    """The records of a file in text order."""
    tokens, out, i = _tokens(text), [], 0
    while i < len(tokens):
        if tokens[i][1] != "def" or i + 2 >= len(tokens) or tokens[i + 1][0] != "word" or tokens[i + 2][1] != ":":
            i += 1
            continue
        record = Record(tokens[i][2], tokens[i + 1][1], [])
        i += 3
        while i < len(tokens) and tokens[i][0] == "word":
            parent = Parent(tokens[i][1])
            i += 1
            if i < len(tokens) and tokens[i][1] == "<":
                depth, parent.start, first = [">"], tokens[i][2] + 1, i + 1
                i += 1
                while i < len(tokens) and tokens[i][1] != ";":  # an argument list that nothing closes ends with its statement
                    kind, mark, _ = tokens[i]
                    if kind == "mark" and mark in _OPEN:
                        depth.append(_OPEN[mark])
                    elif kind == "mark" and mark == depth[-1]:
                        depth.pop()
                        if not depth:
                            break
                    i += 1
                parent.end = tokens[i][2] if i < len(tokens) else len(text)
                parent.tokens = [(k, t) for k, t, _ in tokens[first:i]]
                i += not depth
            record.parents.append(parent)
            if i < len(tokens) and tokens[i][1] == ",":
                i += 1
                continue
            break
        out.append(record)
    return out


def _described(text: str, record: Record) -> dict:
    """Kind, summary, severity and group of a record."""
    kind = next((p for p in record.parents if p.strings()), record.parents[0] if record.parents else Parent(""))
    own = kind.strings()
    given = text[kind.start : kind.end]
    severity, group, flag, mixins = SEVERITY.get(kind.name), None, None, []
    for p in record.parents:
        if p is kind:
            continue
        severity = CHANGES.get(p.name, severity)
        if p.name == "InGroup" and p.tokens:
            if p.tokens[0][1] == "DiagGroup":
                flag = next((t[1:-1] for k, t in p.tokens if k == "string"), None)
            else:
                group = p.tokens[0][1]
        else:
            mixins.append(p.name)
    return {"pos": record.pos, "name": record.name, "kind": kind.name, "summary": strip_summary(given + "\n") or None, "raw": "".join(own) or given.strip() or None, "severity": severity, "group_name": group, "flag": flag, "mixins": mixins}


def _subgroups(record: Record) -> tuple[str, list[str]] | None:
    """Flag and names of subgroups if the record is a group."""
    found = next((p for p in record.parents if p.name == "DiagGroup" and p.strings()), None)
    if found is None:
        return None
    listed = [t for k, t in found.tokens[1:] if k == "word"]
    return "".join(found.strings()), listed


def scan_definitions(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, text: one row per definition file; below folders, files that cannot be read are skipped."""
    reader = spark.read.option("ignoreCorruptFiles", str(recursive).lower()).option("pathGlobFilter", "*.td").option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def definition_names(files: DataFrame) -> DataFrame:
    """file, name of every record, whatever its class."""
    return files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"\bdef\s+(\w+)\s*:"), F.lit(1))).alias("name"))


def diagnostics(files: DataFrame) -> DataFrame:
    """The records of files (file, text) that are diagnostics: file, pos, name, kind, summary, raw, severity, group_name, flag, mixins.

    ``summary`` is as the rules take it; ``raw`` the strings as written, joined.  A group made on the spot has a flag and no name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = ({"file": file, **_described(text or "", r)} for file, text in zip(b["file"], b["text"]) for r in records_of(text or ""))
            kept = (r for r in found if r["kind"] in SEVERITY and r["summary"] is not None)
            while rows := list(islice(kept, 10_000)):
                yield pd.DataFrame(rows)

    return files.select("file", "text").mapInPandas(run, RECORDS)


def groups(files: DataFrame) -> DataFrame:
    """The groups of warnings that files (file, text) define by name: file, pos, name, flag, subgroups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = ((file, r.pos, r.name, *found) for file, text in zip(b["file"], b["text"]) for r in records_of(text or "") if (found := _subgroups(r)))
            while rows := list(islice(kept, 10_000)):
                yield pd.DataFrame(rows, columns=["file", "pos", "name", "flag", "subgroups"])

    return files.select("file", "text").mapInPandas(run, GROUPS)


def flagged(files: DataFrame) -> DataFrame:
    """``groups`` and ``diagnostics`` of files that are parsed once: file, pos, name, group_name, flag, subgroups (null for a diagnostic)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows_of(file: str, text: str) -> Iterator[tuple]:
            for r in records_of(text):
                if found := _subgroups(r):
                    yield file, r.pos, r.name, None, *found
                d = _described(text, r)
                if d["kind"] in SEVERITY and d["summary"] is not None:
                    yield file, r.pos, r.name, d["group_name"], d["flag"], None

        for b in batches:
            found = (row for file, text in zip(b["file"], b["text"]) for row in rows_of(file, text or ""))
            while rows := list(islice(found, 10_000)):
                yield pd.DataFrame(rows, columns=["file", "pos", "name", "group_name", "flag", "subgroups"])

    return files.select("file", "text").mapInPandas(run, FLAGGED)


def named_texts(texts: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """What ``%sub{NAME}`` stands for, and what ``NAME.Summary`` does, by name."""
    subs, summaries = {}, {}
    for text in texts:
        for r in records_of(text):
            for p in (p for p in r.parents if p.strings()):
                (subs if p.name == "TextSubstitution" else summaries).setdefault(r.name, strip_summary(text[p.start : p.end] + "\n"))
    return subs, summaries


def parse_definitions(text: str, kinds: tuple[str, ...] = RULE_KINDS) -> list[tuple[int, str, str, str]]:
    """(offset, name, kind, summary) of the records of the given kinds: those of the first kind, then those of the next."""
    found = [(r.pos, r.name, p.name, strip_summary(text[p.start : p.end] + "\n")) for r in records_of(text) for p in r.parents[:1] if p.name in kinds and p.end]
    return sorted(found, key=lambda r: (kinds.index(r[2]), r[0]))


def catalogue(spark: SparkSession, path: str, mode: str = "compat", recursive: bool = False) -> DataFrame:
    """The rules of all files below ``path`` in the order of files, then kinds, then text; of equal names the last text at the first place.

    A catalogue is some thousand records, so it is compiled on the driver, once.  ``fixed`` expands the
    substitutions of all files and takes a summary that names another record's from there.
    """
    files = [(r.file, r.text) for r in scan_definitions(spark, path, recursive).orderBy("file").toLocalIterator()]
    subs, summaries = named_texts([t for _, t in files]) if mode == "fixed" else ({}, {})
    compiler = Compiler(mode, subs)
    rules: dict[str, tuple] = {}
    for file, text in files:
        for at, name, kind, summary in parse_definitions(text):
            summary = summaries.get(summary.removesuffix(".Summary"), summary) if summary.endswith(".Summary") else summary
            pattern = compiler.compile(summary)
            rules[name] = (file, at, name, kind, summary, pattern, is_valid(pattern))
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(rules.values())], SCHEMA)
