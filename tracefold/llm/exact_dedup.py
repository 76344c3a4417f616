"""Exact dedup over a log-structured merge index of text digests.  DataFrame functions only.

Rows are dealt to memtables.  A memtable keeps one entry per digest (identifier to keep, number of rows)
and is flushed as a run of its own, sorted by digest, with a filter: a bit map of its digests.
An entry whose digest no filter of an older run holds is the first of its digest.  Compaction merges
runs: only digests that an older run may hold too are brought together, the other entries pass into the new
run as they are; the smallest (or largest) identifier stays and the counts add up.  Digests of
more than one row are hits; a bit map of the hits decides, at the scan, which rows carry
their text to the byte comparison with the text of the row that stays.

Scale: only (digest, identifier) is shuffled for all rows, after a map-side combine, so a text that
a third of the rows share arrives as one entry per task and memtable.  Texts are shuffled for hits
alone; the rows of a hot text are dealt over parts, its kept text goes to each.  A bit map has
``filter_bits`` bits whatever the input, so broadcasts are bounded by that and the number of runs; when
they fill, more entries are merged, more texts travel and the result stays the same.

Defined results: a null text counts as empty; equal empty texts are copies of one another.  A null
identifier never stays when its group has another one.  Rows that repeat identifier and text count
each in ``group_size`` and share the decision; ``deduplicate`` leaves one of them.  An empty table
gives an empty result.  Extra columns are ignored here and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, remove, split_join, table

BUCKET = 32_768  # bits that one row of bitmap_construct_agg holds


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class MergeIndex:
    """Sorted runs of (digest, keep_id, n) below ``path``, each with a filter; ``keep`` is 'smallest' or 'largest'.

    ``id_type`` is the type of the identifiers.  More than ``fan_in`` runs are compacted into one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", fan_in: int = 8, id_type: str = "bigint", filter_bits: int = 1 << 22):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep: {keep!r}")
        self.spark, self.keep, self.fan_in, self.id_type, self.filter_bits = spark, keep, fan_in, id_type, filter_bits
        self.path = path or fresh_path(spark, "merge-index")
        self.stored: list[str] = []  # folders of runs; a run is a folder run=K in one of them
        self.runs: list[int] = []
        self.next = 0

    def _pick(self, col: str) -> Column:
        return (F.min if self.keep == "smallest" else F.max)(col).alias("keep_id")

    def _store(self, entries: DataFrame, runs: list[int]) -> None:
        """entries: run, digest, keep_id, n.  One sorted run and one filter for each number."""
        folder = f"{self.path}/from-{runs[0]}"
        entries.sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(folder)
        self.stored.append(folder)
        self.runs += runs
        self.next = runs[-1] + 1
        at = _place(self.filter_bits)
        filters = self._read([folder]).groupBy("run", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
        filters.write.parquet(f"{folder}-filters")

    def _read(self, folders: list[str]) -> DataFrame:
        each = [self.spark.read.schema(f"digest string, keep_id {self.id_type}, n long, run int").parquet(f) for f in folders]
        return reduce(DataFrame.unionByName, each)

    def filters(self) -> DataFrame:
        """run, bucket, bitmap: at most filter_bits / BUCKET rows for each run."""
        return self.spark.read.schema("run int, bucket long, bitmap binary").parquet(*(f"{f}-filters" for f in self.stored))

    def flush(self, rows: DataFrame, memtables: int = 4) -> None:
        """rows: digest, id.  Each memtable's entries are combined and written as a run."""
        dealt = rows.withColumn("run", (F.pmod(F.xxhash64("id"), F.lit(memtables)) + self.next).cast("int"))
        entries = dealt.groupBy("run", "digest").agg(self._pick("id"), F.count(F.lit(1)).alias("n"))
        self._store(entries, [self.next + k for k in range(memtables)])
        if len(self.runs) > self.fan_in:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one with an entry per digest."""
        if len(self.runs) < 2:
            return
        entries, filters = self._read(self.stored), self.filters()
        before = filters.select(F.col("run").alias("old"), "bucket", "bitmap")
        older = filters.select("run", "bucket").join(before, "bucket").where("old < run").groupBy("run", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        again = may_hold(entries, older, self.filter_bits, ["run", "bucket"]).where("maybe").select("digest")
        probed = may_hold(entries, bit_filter(again, self.filter_bits), self.filter_bits)
        merged = probed.where("maybe").groupBy("digest").agg(self._pick("keep_id"), F.sum("n").alias("n"))
        whole = probed.where("not maybe").select("digest", "keep_id", "n").unionByName(merged)
        old, self.stored, self.runs = self.stored, [], []
        self._store(whole.withColumn("run", F.lit(self.next)), [self.next])
        for folder in old:
            remove(self.spark, folder)
            remove(self.spark, f"{folder}-filters")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digest, keep_id, n of those rows of ``digests`` that are in the index; only what a filter holds reads the runs."""
        held = self.filters().groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        asked = may_hold(digests.select("digest").distinct(), held, self.filter_bits).where("maybe").select("digest")
        return self._read(self.stored).join(asked, "digest", "left_semi").groupBy("digest").agg(self._pick("keep_id"), F.sum("n").alias("n"))

    def entries(self) -> DataFrame:
        """digest, keep_id, n: one row per digest."""
        if not self.runs:
            raise ValueError("nothing was flushed")
        stored = self._read(self.stored)
        return stored.drop("run") if len(self.runs) == 1 else stored.groupBy("digest").agg(self._pick("keep_id"), F.sum("n").alias("n"))

    def drop(self) -> None:
        remove(self.spark, self.path)
        self.stored, self.runs = [], []


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def bit_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) rows, ``bits`` / BUCKET of them at most."""
    at = _place(bits)
    return digests.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def may_hold(rows: DataFrame, bitmaps: DataFrame, bits: int, on: list[str] | None = None) -> DataFrame:
    """Adds ``maybe``: false only for digests that are surely not in the filter (of the row's ``on``)."""
    at = _place(bits)
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", F.bitmap_bit_position(at)).join(F.broadcast(bitmaps), on or ["bucket"], "left")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)).cast("int") % 2
    return joined.withColumn("maybe", F.coalesce(held == 1, F.lit(False))).drop("bucket", "bit", "bitmap")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = sha256,
    memtables: int = 4,
    filter_bits: int = 1 << 22,
) -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept (see the module's text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    index = MergeIndex(spark, keep=keep, id_type=rows.schema["id"].dataType.simpleString(), filter_bits=filter_bits)
    index.flush(rows.select("id", "digest"), memtables)
    index.compact()
    hits = index.entries().where("n > 1")
    total = hits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    probed = may_hold(rows, bit_filter(hits, filter_bits), filter_bits)
    # one text for each hit: that of the row which stays
    first = (
        probed.where("maybe")
        .join(hits.withColumnRenamed("digest", "hit"), F.col("digest") == F.col("hit"))
        .where(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.first("keep_id").alias("keep_id"), F.first("n").alias("n"), F.min("text").alias("kept_text"))
    )
    carried = probed.withColumn("text", F.when(F.col("maybe"), F.col("text")))
    compared = materialise(
        split_join(carried, first, ["digest"], hits.select("digest", F.col("n").alias("rows_of_key")), total, "left").select(
            "id", "digest", "keep_id", "n", F.when(F.col("n").isNotNull() & (F.col("text") != F.col("kept_text")), F.col("text")).alias("other"), (F.col("n").isNull() | (F.col("text") == F.col("kept_text"))).alias("same")
        ),
        "compared",
    )
    index.drop()
    pick = F.min if keep == "smallest" else F.max
    out = compared.select("id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"))
    if not compared.where("not same").isEmpty():
        # Digests that different texts share: such rows are grouped by their bytes (``other`` is null for the text of the first).
        clash = compared.where("not same").select("digest").distinct()
        groups = compared.join(clash, "digest", "left_semi").groupBy("digest", "other").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        both = compared.join(clash, "digest", "left_semi").select("id", "digest", "other").alias("a").join(groups.alias("b"), F.expr("a.digest = b.digest and a.other <=> b.other"))
        apart = both.select("a.id", "a.digest", "b.keep_id", "b.group_size")
        out = out.join(clash, "digest", "left_anti").select("id", "digest", "keep_id", "group_size").unionByName(apart)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("group_size", F.col("group_size").cast("long"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", filter_bits: int = 1 << 22) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of those that repeat id and text.

    Rows that the hits' bit map rules out pass straight through; only the others are joined.
    """
    found = materialise(exact_duplicates(docs, id_col, text_col, keep, filter_bits=filter_bits), "decisions")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    probed = may_hold(packed, bit_filter(found.where("group_size > 1").select("digest"), filter_bits), filter_bits)
    stays = found.where("kept and group_size > 1").select(F.col("id").alias("stay"), F.col("digest").alias("hit"))
    single = found.where("group_size = 1").select(F.col("id").alias("stay"), F.col("digest").alias("hit"))
    on = F.col("id").eqNullSafe(F.col("stay")) & (F.col("digest") == F.col("hit"))
    kept = probed.where("maybe").join(stays.unionByName(single), on, "left_semi").dropDuplicates(["id", "digest"])
    return probed.where("not maybe").select("row.*").unionByName(kept.select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, the largest identifier stays: doc_id, keep_id, group_size, kept, text_sha256."""
    found = exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
