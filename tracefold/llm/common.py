"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent a fresh folder is made and set, but on a local master alone: executors of a
    cluster would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracefold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders written and not yet removed.
_paths: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back.  Survives the loss of any executor.

    The folder stays, as later plans read it, until ``forget`` or ``clean``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return owned(spark.read.schema(df.schema).parquet(path), path)


def owned(df: DataFrame, path: str) -> DataFrame:
    """Note that ``df`` reads the folder ``path``, which nothing else does."""
    _paths.append(path)
    df._written_to = path
    return df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` texts for what runs inside; the caller's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Remove the folders of written tables that no plan still to be run reads."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            remove(t.sparkSession, path)
            _paths.remove(path)


def mark() -> int:
    """How many folders are there now, for ``clean``."""
    return len(_paths)


def clean(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the folders that operators have written since a ``mark``, but that of ``keep``; for the caller, once results are stored."""
    kept = getattr(keep, "_written_to", None)
    for path in _paths[since:]:
        if path != kept:
            remove(spark, path)
            _paths.remove(path)


def split_join(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, total: int, how: str = "inner", spread: str = "id", pieces: int = 1000) -> DataFrame:
    """Join that no key can make uneven; ``right`` has one row per key.

    ``sizes`` holds the keys and ``rows_of_key``, the rows that ``left`` has of each; their sum is at most ``total``.
    A key of more than ``total`` / ``pieces`` rows is hot.  There are fewer than 2 * ``pieces`` hot keys at any size of the
    input, so their broadcast is bounded.  Their rows are dealt over parts by the hash of ``spread``; the row on the
    right is repeated for each part.  Keys must not be null.
    """
    most = max(1, total // pieces)
    parts = F.ceil(F.col("rows_of_key") / most).cast("int")
    hot = sizes.where(F.col("rows_of_key") > most).select(*on, parts.alias("_parts"))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = right.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"], how).drop("_part")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
