"""Coverage over label counts and catalogues: merging, gaps, rankings per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Platform words, lower-cased; a catalogue name that contains one in any case is left out.
PLATFORMS = ("hip", "cuda", "omp", "acc", "microsoft", "objc", "mips", "aarch64", "ppe", "_ms", "_amd", "apple", "macos", "_arm")


def merge_counts(*maps: DataFrame) -> DataFrame:
    """Sum of (name, n) maps over shared names."""
    return reduce(DataFrame.unionByName, maps).groupBy("name").agg(F.sum("n").alias("n"))


def contains_any(name: Column, words=PLATFORMS) -> Column:
    return F.lower(name).rlike("|".join(words))


def gap(catalogue: DataFrame, observed: DataFrame, on: str = "name") -> DataFrame:
    """Catalogue rows whose name was not observed; repeated rows stay."""
    return catalogue.join(observed.select(on).distinct(), on, "left_anti")


def ranked(counts: DataFrame) -> DataFrame:
    """Adds the place by descending count, ties by name.  The input has one row per label."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("long"))


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key: an aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def top_per_key(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    """At most n rows of each key, nulls of a named column last; each task sends n of a key at most."""
    by = [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by)).cast("long")).where(F.col("place") <= n)


def collected(rows: DataFrame, key: str, *parts: str) -> DataFrame:
    """Each key's parts, sorted, as an array of structs."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("parts"))


def sliced(rows: DataFrame, order: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (from 0, exclusive) in the order of a unique column: a report of bounded length."""
    return rows.orderBy(order).offset(start).limit(stop - start)


def names_of(rows: DataFrame, ids: str, names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Adds ``names``: those of the identifiers in the array ``ids``, in its order; an unknown one is ''.  ``rows`` has a unique column ``row``."""
    each = rows.select("row", F.posexplode(ids).alias("pos", "_id")).join(names.select(F.col(key).alias("_id"), F.col(name).alias("_name")), "_id", "left")
    found = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_name", F.lit("")).alias("name")))).alias("found"))
    return rows.join(found, "row", "left").withColumn("names", F.coalesce(F.transform("found", lambda x: x["name"]), F.array().cast("array<string>"))).drop("found")


def attempts(rows: DataFrame, key: str, order: list[str], small: Column, large: Column, n: int = 3) -> DataFrame:
    """What a run makes of the first ``n`` places of each key, each tried with the small model, then with the large one, until one succeeds.

    key, n_small, n_large (tries), solved_by ('small', 'large' or null) and solved_at (place from 1, null if none).
    Rows that are equal in ``order`` stand by what they give, failures first, so that the result does not hang on how the rows come.
    """
    first = top_per_key(rows.select(key, *order, F.coalesce(small, F.lit(False)).alias("_s"), F.coalesce(large, F.lit(False)).alias("_l")), key, n, *order, "_s", "_l")
    found = first.groupBy(key).agg(F.count(F.lit(1)).alias("places"), F.min(F.when(F.col("_s") | F.col("_l"), F.struct("place", F.when(F.col("_s"), "small").otherwise("large").alias("by")))).alias("hit"))
    tried = F.coalesce("hit.place", "places")
    return found.select(key, tried.alias("n_small"), (tried - F.when(F.col("hit.by") == "small", 1).otherwise(0)).alias("n_large"), F.col("hit.by").alias("solved_by"), F.col("hit.place").alias("solved_at"))


def lookback(lines: DataFrame, key: str, at: str, text: str, word: str) -> DataFrame:
    """Adds ``since``: the lines from the last one that contains ``word`` up to this one, joined by newlines."""
    so_far = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_run", F.sum(F.col(text).contains(word).cast("int")).over(so_far))
    run = Window.partitionBy(key, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("since", F.array_join(F.collect_list(text).over(run), "\n")).drop("_run")


def pending(left: DataFrame, right: DataFrame, done: DataFrame, on: list[str], most: int = 10_000) -> DataFrame:
    """All combinations of the rows of both tables, less those done.

    ``right`` may hold ``most`` rows; they become one array that each row of ``left`` is exploded by.
    """
    listed = right.limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} rows on the right")
    one = left.sparkSession.createDataFrame([(listed,)], StructType([StructField("_all", ArrayType(right.schema))]))
    return left.join(F.broadcast(one)).select("*", F.explode("_all").alias("_right")).drop("_all").select(*left.columns, "_right.*").join(done, on, "left_anti")
