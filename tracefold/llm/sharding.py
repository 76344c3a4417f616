"""Sharding by histogram sort.  DataFrame functions only.

Every row has a 62-bit key (hash of its text) and a size in bytes.  Shards are key ranges: the exact
bytes below evenly spaced probes (places by integer division) are counted in all partitions, the probes around each wanted
boundary are refined, and this repeats until the bytes below every splitter are within ``tolerance``
of a shard's share.  Then each row knows its shard and one exchange numbers the rows.

Law ``bytes``: shards hold nearly equal bytes; equal texts share a shard.  Groups of equal texts
above ``tolerance`` of a shard (at most shards / tolerance of them) are placed one by one, largest
first on the lightest shard, and the key ranges fill up what is left.  A group above a shard's whole
share cannot stay together under this law: its rows get keys of their own and are spread.

Scale: the text is read once; after that only (id, size, checksum, key, row) moves.  ``row`` numbers the rows as they were
first written; it deals rows over bins, so null or repeated identifiers and rows that are wholly equal spread as well.
Where executors are lost, rows written keep their numbers; another run may number them otherwise.  A histogram has
``probes`` bins per open boundary, so what reaches the driver is bounded by parameters.  Slots are
numbered in (shard, bin) pieces, whose number grows with the rows, so no shard is one task.

Defined results: a null text has size 1 and the checksum of empty bytes; empty texts likewise.
Rows that repeat an identifier get slots of their own.  A null identifier counts as one more value.
An empty table gives no rows.  A shard may be empty when rows are few or one row outweighs a shard.
Extra columns are ignored by ``assign`` and kept by ``write_shards``, which picks free names for its own two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, fresh_path, materialise, table

LOW, HIGH = 0, 1 << 62  # keys: [LOW, HIGH)


def _counts(rows: DataFrame, edges: list[tuple[int, int]], probes: int) -> list[dict[int, int]]:
    """Exact bytes per bin for each open interval [low, high) of the key, in one pass."""
    which, start, step = (F.lit(None).cast(t) for t in ("int", "long", "long"))
    for i, (low, high) in reversed(list(enumerate(edges))):
        inside = (F.col("key") >= low) & (F.col("key") < high)
        which = F.when(inside, F.lit(i)).otherwise(which)
        start = F.when(inside, F.lit(low).cast("long")).otherwise(start)
        step = F.when(inside, F.lit(max(1, -(-(high - low) // probes))).cast("long")).otherwise(step)
    placed = rows.select("key", "size", which.alias("i"), start.alias("start"), step.alias("step")).where("i is not null")
    binned = placed.select("i", F.expr("(key - start) div step").alias("bin"), "size")
    out: list[dict[int, int]] = [{} for _ in edges]
    for r in binned.groupBy("i", "bin").agg(F.sum("size").alias("size")).collect():
        out[r.i][r.bin] = r["size"]
    return out


def splitters(rows: DataFrame, wanted: list[float], slack: float, probes: int = 1024) -> list[int]:
    """Keys, so that the bytes of smaller keys are within ``slack`` of each ``wanted`` sum, or as near as keys allow.

    rows: key long, size long.
    """
    low, high, below = [LOW] * len(wanted), [HIGH] * len(wanted), [0] * len(wanted)
    best: list[tuple[float, int]] = [(abs(w), LOW) for w in wanted]
    open_ = [k for k, (miss, _) in enumerate(best) if miss > slack]
    while open_:
        edges = sorted({(low[k], high[k]) for k in open_})
        counted = _counts(rows, edges, probes)
        for k in open_:
            i = edges.index((low[k], high[k]))
            width, done = max(1, -(-(high[k] - low[k]) // probes)), below[k]
            lo, hi, at_lo = low[k], high[k], below[k]
            for b in sorted(counted[i]):
                edge = min(low[k] + width * b, high[k])
                for at, total in ((edge, done), (min(edge + width, high[k]), done + counted[i][b])):
                    if abs(total - wanted[k]) < best[k][0]:
                        best[k] = (abs(total - wanted[k]), at)
                if done <= wanted[k] < done + counted[i][b]:
                    lo, hi, at_lo = edge, min(edge + width, high[k]), done
                done += counted[i][b]
            low[k], high[k], below[k] = (lo, hi, at_lo) if (lo, hi) != (low[k], high[k]) else (lo, lo, at_lo)
        open_ = [k for k in open_ if best[k][0] > slack and high[k] - low[k] > 1]
    return [at for _, at in best]


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005, rows_per_bin: int = 100_000, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, key, row, shard, slot.  ``row`` must be a number of its own for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, key = (F.octet_length(text) + 1).cast("long"), F.shiftrightunsigned(F.xxhash64(text, F.octet_length(text)), 2)
    number_of = F.monotonically_increasing_id() if row is None else row
    rows = materialise(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), number_of.alias("row")), "shard-keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = total / shards
    # At most shards / tolerance groups are that heavy.
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > tolerance * share) & (F.col("n") > 1)).collect()
    huge = [r.key for r in heavy if r.bytes > share]
    load = [0] * shards
    home: dict[int, int] = {}
    for r in sorted((r for r in heavy if r.bytes <= share), key=lambda r: (-r.bytes, r.key)):
        home[r.key] = min(range(shards), key=lambda s: (load[s], s))
        load[home[r.key]] += r.bytes
    spark = docs.sparkSession
    placed = spark.createDataFrame([(k, home.get(k), k in huge) for k in [*home, *huge]], "heavy long, home int, huge boolean")
    rows = rows.join(F.broadcast(placed), F.col("key") == F.col("heavy"), "left").withColumn("key", F.when(F.col("huge"), F.shiftrightunsigned(F.xxhash64("row"), 2)).otherwise(F.col("key"))).drop("heavy", "huge")
    light = rows.where("home is null")
    # What the key ranges put into each shard: its share less what is placed; a shard that is over it takes none.
    room = [max(0.0, share - x) for x in load]
    loose, scale = total - sum(load), sum(room)
    room = [x * loose / scale if scale else 0.0 for x in room]
    wanted = [sum(room[: k + 1]) for k in range(shards - 1)]
    at = splitters(light, wanted, tolerance * share) if n else [LOW] * (shards - 1)
    for k in range(1, len(at)):
        at[k] = max(at[k], at[k - 1])
    ranged = sum((F.when(F.col("key") >= x, 1).otherwise(0) for x in at), F.lit(0))
    dealt = rows.withColumn("shard", F.coalesce("home", ranged).cast("int")).drop("home")
    bins = max(8, -(-n // (shards * rows_per_bin)))
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(bins)).cast("int"))
    return number(dealt)


def number(dealt: DataFrame) -> DataFrame:
    """Adds a slot, gapless from 0 in each shard: numbered in (shard, bin), after the rows of smaller bins."""
    counts = dealt.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("key", "id", "row")) - 1
    return dealt.withColumn("inside", inside).join(before.select("shard", "bin", "before"), ["shard", "bin"]).withColumn("slot", (F.coalesce("before", F.lit(0)) + F.col("inside")).cast("long")).drop("inside", "before", "bin")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of that name is there (case apart)."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> str:
    """Write the rows with all their columns and slot below ``path``, a folder per shard."""
    path = path or fresh_path(docs.sparkSession, "shards")
    shard, slot = (free_name(c, docs.columns) for c in ("shard", "slot"))
    # a copy whose rows keep their numbers in both passes
    copy = materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    where = assign(copy.select(F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"), "row"), shards, "id", "text", row=F.col("row"), **options)
    out = copy.join(where.select("row", F.col("shard").alias("_to"), F.col("slot").alias("_at")), "row")
    out.select("doc.*", F.col("_at").alias(slot), F.col("_to").alias(shard)).write.partitionBy(shard).parquet(path)
    forget(copy)
    return path


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    out = assign(table(spark, sf_dir, "documents"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
