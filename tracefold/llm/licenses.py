"""License scans: an exact set-similarity join of text blocks with license templates.  DataFrame functions only.

A template is a set of words; a text matches when a window of consecutive words, ``SPAN`` times as long as the
template's sentence, holds at least ``threshold`` of them (containment).  Line breaks are separators like any
other; besides, a line no longer than the longest window is a block as a whole.  A text is cut into blocks of twice the longest window that overlap by half, so each window of each
template lies in a block.  The words of all templates are counted over the whole corpus and ordered by that
frequency, rarest first.  A match must hold one of the first |T| - ceil(threshold * |T|) + 1 words of T (prefix
filter), be long enough (length filter) and, from the place of the first common word, still have enough words
left on both sides (positional filter).  Candidates come from an equi-join of blocks on prefix words, are verified
by exact intersection and then window by window.

``OP10_SQL`` takes lines instead of windows: equal where each notice is on one line and near together.

Base labels are plain phrases: places where a phrase's words stand consecutively.

Scale: one pass over the texts writes counts, the template words found in each document and, only
where a whole document can reach some template (the length filter on documents), its text.  Word
frequencies are summed map-side to a row per template word.  The broadcast side is the templates'
prefixes, a parameter.  Nothing is grouped by a word, so frequent words are no hot keys; a
block is of bounded length, and blocks hold each word of a text at most three times.

Defined results: a null or empty text has no words and no labels, score 0.  Rows that repeat
identifier and text give equal rows.  Ties: a label is listed once.  An empty table gives no rows;
extra columns are ignored.  ``score`` is the largest verified containment, 0 if no template is reached.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

#: Phrases of the base and their labels.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
#: Sentences of public licenses and customary statements, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.85  # of a template's words
SPAN = 2  # words of a window by words of the template's sentence
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def _places(phrase: tuple[str, ...]) -> Column:
    """Positions, from 0, where the phrase's words stand consecutively in ``words``."""

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, w in enumerate(phrase):
            same = same & F.coalesce(F.get("words", i + k) == w, F.lit(False))
        return same

    return F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)


def _sequence(text: str) -> list[str]:
    import re

    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def _literal(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _most(words, span: int) -> Column:
    """The largest number of ``words`` in a window of ``span`` words of ``run``."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("run") - span + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(_literal(words), F.slice("run", i, span)))))


def prefixes(templates, frequency: dict[str, int], threshold: float) -> list[tuple]:
    """(word, template, label, place, size, need) for the words of each template's prefix."""
    out = []
    for t, (label, words) in enumerate(templates):
        ordered = sorted(words, key=lambda w: (frequency.get(w, 0), w))
        need = math.ceil(threshold * len(ordered) - 1e-9)
        out += [(w, t, label, i, len(ordered), need) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    return out


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    sets = [(label, tuple(dict.fromkeys(_sequence(text)))) for label, text in templates]
    spans = [SPAN * len(_sequence(text)) for _, text in templates]
    needs = [math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    universe = sorted({w for _, words in sets for w in words})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    places = {label: _places(phrase) for label, phrase in PHRASES}
    none = F.array().cast("array<int>")
    found = F.when(F.array_contains("words", "license"), F.struct(*(v.alias(k) for k, v in places.items()))).otherwise(F.struct(*(none.alias(k) for k, _ in PHRASES)))
    hits = F.array_intersect("words", _literal(universe))
    rows = rows.select("id", "text", F.size("words").cast("long").alias("n_words"), found.alias("at"), hits.alias("hits"))
    reach = F.lit(False)
    for (_, words), need in zip(sets, needs):
        reach = reach | (F.size(F.array_intersect("hits", _literal(words))) >= need)
    every = F.array_sort(F.flatten(F.array(*(F.col(f"at.{k}") for k, _ in PHRASES))))
    base = F.filter(F.array(*(F.when(F.size(f"at.{k}") > 0, F.lit(k)) for k, _ in PHRASES)), lambda x: x.isNotNull())
    rows = materialise(
        rows.select(
            "id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
            F.array_sort(base).alias("base"), "hits", F.when(reach, F.col("text")).alias("text"), F.when(reach, F.xxhash64("text")).alias("version"),
        ),
        "license-words",
    )
    # the global order: documents per template word, a row for each of them
    frequency = {r.word: r.n for r in rows.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = spark.createDataFrame(prefixes(sets, frequency, threshold), "word string, template int, label string, place int, size int, need int")
    ranked = [w for w in sorted(universe, key=lambda w: (frequency.get(w, 0), w))]

    step = max(spans)
    blocks = rows.where("text is not null").select("id", "version", words_of(F.col("text")).alias("words"), "text")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / step).cast("int") - 2, F.lit(0)))
    tiles = F.transform(starts, lambda k: F.struct(F.slice("words", k * step + 1, 2 * step).alias("run"), F.lit(False).alias("whole")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(words_of(x).alias("run"), F.lit(True).alias("whole")))
    lines = F.filter(lines, lambda x: F.size(x["run"]) <= step)
    blocks = blocks.select("id", "version", F.posexplode(F.concat(tiles, lines)).alias("block", "b")).select("id", "version", "block", "b.run", "b.whole")
    held = F.array_intersect(_literal(ranked), F.col("run"))  # in the global order
    blocks = blocks.select("id", "version", "block", "run", "whole", held.alias("held")).where(F.size("held") >= min(needs))
    probes = blocks.select("id", "version", "block", "run", "whole", "held", F.posexplode("held").alias("seat", "word"))
    near = probes.join(F.broadcast(index), "word").where((F.col("size") - F.col("place") >= F.col("need")) & (F.size("held") - F.col("seat") >= F.col("need")))
    sizes, most = F.lit(0), F.lit(0)
    for t, ((_, words), span) in reversed(list(enumerate(zip(sets, spans)))):
        sizes = F.when(F.col("template") == t, F.size(F.array_intersect("held", _literal(words)))).otherwise(sizes)
        most = F.when(F.col("template") == t, F.when(F.col("whole"), F.size(F.array_intersect("run", _literal(words)))).otherwise(_most(words, span))).otherwise(most)
    near = near.where(sizes >= F.col("need")).select("id", "version", "block", "run", "whole", "template", "label", "size", "need").dropDuplicates(["id", "version", "block", "template"])
    matched = near.withColumn("common", most).where("common >= need").groupBy("id", "version").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("score"))
    matched = matched.withColumnsRenamed({"id": "m_id", "version": "m_version"})
    out = rows.drop("text", "hits").join(matched, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("version") == F.col("m_version")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (see the module's text)."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP10_SQL = (
    r"""
WITH t(seat, label, body) AS (VALUES
    {templates}),
  ts AS (SELECT seat, label, list_distinct(list_filter(regexp_split_to_array(lower(body), '{sep}'), lambda x: x <> '')) AS words FROM t),
  d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
  w AS (SELECT r, doc_id, list_filter(regexp_split_to_array({lower}, '{sep}'), lambda x: x <> '') AS words FROM d),
  spots AS (SELECT r,
      list_filter(range(len(words)), lambda i: words[i + 1] = 'mit' AND words[i + 2] = 'license') AS mit,
      list_filter(range(len(words)), lambda i: words[i + 1] = 'apache' AND words[i + 2] = 'license') AS apache,
      list_filter(range(len(words)), lambda i: words[i + 1] = 'general' AND words[i + 2] = 'public' AND words[i + 3] = 'license') AS gpl
    FROM w),
  lines AS (SELECT r, list_distinct(list_filter(regexp_split_to_array(line, '{sep}'), lambda x: x <> '')) AS held
    FROM (SELECT r, unnest(string_split({lower}, chr(10))) AS line FROM d)),
  hit AS (SELECT r, label, len(list_intersect(held, words)) / len(words) AS share FROM lines, ts
    WHERE len(list_intersect(held, words)) >= ceil({threshold} * len(words) - 1e-9)),
  m AS (SELECT r, list(DISTINCT label) AS more, max(share) AS score FROM hit GROUP BY r),
  b AS (SELECT r, list_sort(mit || apache || gpl) AS places,
      list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base
    FROM spots)
SELECT w.doc_id, len(w.words) AS n_words, len(places) AS n_base, places[1] AS first_word, places[-1] AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
       coalesce(score, 0.0) AS score
FROM w JOIN b USING (r) LEFT JOIN m USING (r)
"""
    .replace("{templates}", ",\n    ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES)))
    .replace("{lower}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    .replace("{sep}", SEPARATORS)
    .replace("{threshold}", str(THRESHOLD))
)
