"""Fill-in-the-middle: texts are cut at two seeded places and put in another order, by an index of distinct texts.

The index has one row per distinct text: rows are grouped by their SHA-256, the group's set of texts is
kept by content (two texts of one digest stop the job), and where each code point begins in the
UTF-8 bytes is held as an Elias-Fano list, computed once a text, when its documents have joined it by digest
alone.  So a text crosses the network once; ``select`` on the list gives the two byte places of a document's cut.

A digest of more than 1 / ``pieces`` of all rows is hot.  Fewer than ``pieces`` are, and as each stands for that
many rows, their texts weigh less than ``pieces`` times the mean text: they are broadcast, and their
documents stay where they were read.

Defined results: a null text counts as empty; empty texts and texts that hold a sentinel are plain, as is
the share ``plain`` drawn by seed.  The cut depends on identifier and length alone, so rows that repeat an
identifier and a text get equal results, one row each; a null identifier is seeded like an empty one.
Lengths and places count code points.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SAMPLE = 512  # every so many set bits, the place of one is kept


def elias_fano(values: np.ndarray) -> bytes:
    """A non-decreasing list as low bits, unary high bits and every ``SAMPLE``-th set bit's place."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    at = (values >> low) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    high[at] = 1
    bits = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
    samples = at[::SAMPLE].astype(np.int64)
    return np.array([n, low, len(samples)], np.int64).tobytes() + samples.tobytes() + np.packbits(bits, bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(blob: bytes, i: int) -> int:
    """Value ``i`` of the list; reads from the nearest sample on."""
    n, low, samples = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    if not 0 <= i < n:
        raise IndexError(i)
    lows, highs = 24 + 8 * samples, 24 + 8 * samples + (n * low + 7) // 8
    start = int(np.frombuffer(blob, np.int64, 1, 24 + 8 * (i // SAMPLE))[0])
    end = int(np.frombuffer(blob, np.int64, 1, 32 + 8 * (i // SAMPLE))[0]) + 1 if i // SAMPLE + 1 < samples else (len(blob) - highs) * 8
    held = np.unpackbits(np.frombuffer(blob, np.uint8, (end + 7) // 8 - start // 8, highs + start // 8), bitorder="little")
    bit = int(np.flatnonzero(held[start % 8 :])[i % SAMPLE]) + start
    value = bit - i
    if low:
        first = i * low
        chunk = int.from_bytes(blob[lows + first // 8 : lows + (first + low + 7) // 8], "little") >> (first % 8)
        value = value << low | chunk & ((1 << low) - 1)
    return value


def boundaries(text: str) -> np.ndarray:
    """Where each code point of the UTF-8 bytes begins, and their end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int64)


def _listed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Lists of texts; documents of one text follow each other, and its list is computed once."""
    last, found = None, b""
    for digests, texts in batches:
        out = []
        for digest, text in zip(digests, texts):
            if digest != last:
                last, found = digest, elias_fano(boundaries(text))
            out.append(found)
        yield pd.Series(out, dtype=object)


def _places(lists: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"a": [select(x, i) for x, i in zip(lists, a)], "b": [select(x, i) for x, i in zip(lists, b)]}, dtype="int32")


def seeds(id_col: Column) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of ``1:`` and the identifier."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def text_index(rows: DataFrame) -> DataFrame:
    """digest, text, n: one row per distinct text of rows (digest, text), dealt by digest."""
    grouped = rows.groupBy("digest").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("string"))
    return grouped.select("digest", one.alias("text")).select("digest", "text", F.char_length("text").cast("long").alias("n"))


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``starts``, the Elias-Fano list of the text's code points."""
    return rows.withColumn("starts", F.pandas_udf(_listed, "binary")("digest", "text"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = 10, spm: int = 20, pieces: int = 1000) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output.

    ``plain`` of 100 texts stay as they are; ``spm`` of 100 others begin with their suffix.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    most = max(1, docs.count() // pieces)
    hot = F.broadcast(materialise(counts.where(F.col("copies") > most).select("digest"), "hot-texts"))  # fewer than pieces digests
    asked = rows.select("id", "digest")
    warm = with_starts(text_index(rows.join(hot, "digest", "left_semi")))
    cold = text_index(rows.join(hot, "digest", "left_anti"))
    # lists come after the join: a Python column would hide that the texts are dealt by digest, and they would cross the network again
    found = with_starts(cold.join(asked.join(hot, "digest", "left_anti").hint("shuffle_hash"), "digest")).unionByName(asked.join(F.broadcast(warm), "digest"))

    h1, h2, h3, h4 = seeds(F.col("id"))
    whole = (F.col("n") == 0) | (h3 % 100 >= 100 - plain)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        whole = whole | F.col("text").contains(mark)
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = found.select("id", "text", "n", "starts", F.when(whole, "plain").when(h4 % 100 < spm, "spm").otherwise("psm").alias("form"), F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b"))
    raw, at = F.col("text").cast("binary"), F.col("_at")
    part = lambda start, n: F.substring(raw, start, n)
    prefix, middle, suffix = part(F.lit(1), at["a"]), part(at["a"] + 1, at["b"] - at["a"]), part(at["b"] + 1, F.octet_length("text"))
    mark = lambda m: F.lit(m).cast("binary")
    psm = F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    spm_ = F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    shown = lambda c: F.when(F.col("form") != "plain", c)
    return cut.withColumn("_at", F.pandas_udf(_places, "struct<a: int, b: int>")("starts", "_a", "_b")).select(
        "id", "n", "form", shown(F.col("_a")).alias("prefix_chars"), shown(F.col("_b") - F.col("_a")).alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm.cast("string")).otherwise(spm_.cast("string")).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form alone."""
    end = F.char_length(output)
    before = lambda c, m: F.substring_index(c, m, 1)
    after = lambda c, m: F.substring(c, F.char_length(before(c, m)) + 1 + len(m), end)
    rest = F.substring(output, F.lit(4), end)
    psm = F.concat(before(rest, SUFFIX), after(rest, MIDDLE), before(after(rest, SUFFIX), MIDDLE))
    spm = F.concat(before(after(rest, PREFIX), MIDDLE), after(rest, MIDDLE), before(rest, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, n, form, prefix_chars, middle_chars and digests of output and restored text (see the module's text)."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', cast(doc_id AS VARCHAR))) AS h FROM documents),
s AS (SELECT *, cast(length(text) AS BIGINT) AS n, cast(concat('0x', h[1:8]) AS BIGINT) AS h1, cast(concat('0x', h[9:16]) AS BIGINT) AS h2, cast(concat('0x', h[17:24]) AS BIGINT) AS h3, cast(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM s),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
