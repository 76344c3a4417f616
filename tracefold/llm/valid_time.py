"""Valid-time enrichment of sales by a stateful stream: each sale gets its client's version that held when it was sold.

Sales and versions are one union of rows, fed in batches to ``transformWithState``.  State is two ListStates:
versions sorted by (client, valid_at, seq, change_id), and sales that wait for the watermark.  Each
key gets a clock row a batch that carries the watermarks of both tables.  On a batch, new versions are
merged in (those below their table's watermark are late), due sales are bisected among their client's
versions and emitted, then versions that the watermark has passed are pruned but for the last of a client.

Clients are keyed in groups, some ``rows_per_key`` rows to a key over the whole run: a call and a state access
for each client costs some milliseconds of Python, which the limits do not allow.  Within a key, sorting,
bisection and pruning are by client.  A client with more than ``rows_per_key`` rows and 1 / ``pieces`` of all is hot:
there are at most ``pieces``, and each is cut into slices of time, a key for each.  A slice bisects among
its own versions and reports how many it holds and its last; what a sale in a slice takes from earlier
slices, and the sum of what is held, is joined to the emitted rows afterwards (``_resolve``).

Recovery: batches are written before they are fed, every start commits to one checkpoint, and the sink's
log makes its files exactly-once.

Defined results: a sale without a client has no versions; changes without a client can be late but are
nobody's version.  Sales without an arrival go into the last batch, as ``least`` passes over nulls; batches
before the first are the first.  A null seq or change_id sorts first, ties are settled by balance and op.
A sale without a time matches nothing and is emitted at once.  A balance that is no finite number counts as
null.  Rows of sales that repeat are emitted as often; changes that repeat in all columns count once.
Empty tables give empty batches.  Extra columns are ignored.  Versions of one client and one instant, and
sales too, share a slice however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import fresh_path, owned, table

NONE = -(1 << 63)  # stands for null in columns of numbers
LOWEST = NONE + 1  # a watermark before everything
HIGHEST = (1 << 63) - 1
FEED = "bucket long, slice long, kind string, client long, id long, at long, seq long, cents long, op string, batch int, sales_mark long, changes_mark long"
OUT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string, client long, slice long, own boolean, version_at long, settled boolean"
VERSION = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("id", pa.int64()), ("cents", pa.int64()), ("op", pa.string()), ("settled", pa.bool_())])
SALE = pa.schema([("client", pa.int64()), ("id", pa.int64()), ("at", pa.int64())])
RUN = 16384  # rows in an element of a list
SUBS = 1 << 40  # slices below one cut


def micros(c: Column) -> Column:
    """Microseconds of a time of day without a zone, whatever the session's zone is; NONE for null."""
    whole = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return F.coalesce(whole * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long"), F.lit(NONE))


def batch_number(day: Column, batches: int = 8, first: int = 19723, days: int = 152) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first) * batches / days))).cast("int")


def day_of(c: Column) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


def sale_rows(sales: DataFrame, batches: int = 8) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    return sales.select(F.lit("sale").alias("kind"), number("client_id").alias("client"), number("sale_id").alias("id"), micros(F.col("sold_at")).alias("at"), F.lit(NONE).alias("seq"), F.lit(NONE).alias("cents"), F.lit(None).cast("string").alias("op"), batch_number(day_of(F.col("arrived_at")), batches).alias("batch"))


def change_rows(changes: DataFrame, batches: int = 8) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    shift = F.pmod(F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit(""))), F.lit(4))
    balance = F.col("balance").cast("double")
    cents = F.when(F.isnan(balance) | (F.abs(balance) > 9e15), F.lit(None)).otherwise(F.floor(100 * balance + 0.5))
    return changes.distinct().where(F.col("valid_at").isNotNull()).select(F.lit("change").alias("kind"), number("client_id").alias("client"), number("change_id").alias("id"), micros(F.col("valid_at")).alias("at"), number("seq").alias("seq"), F.coalesce(cents, F.lit(NONE)).alias("cents"), "op", batch_number(day_of(F.col("valid_at")) + shift, batches).alias("batch"))


# ---- state ----


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> list[tuple[bytes]]:
    whole = pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    out = []
    for start in range(0, len(frame), RUN):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=options) as writer:
            writer.write_batch(whole.slice(start, RUN))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(rows: Iterator[tuple], schema: pa.Schema) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(r[0]).read_all() for r in rows]
    return (pa.concat_tables(parts) if parts else schema.empty_table()).to_pandas()


def merged(versions: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    if not len(fresh):
        return versions
    out = pd.concat([versions, fresh], ignore_index=True) if len(versions) else fresh
    return out.assign(_op=out["op"].fillna("")).sort_values(["client", "at", "seq", "id", "cents", "_op"], ignore_index=True).drop(columns="_op")


def bisect(versions: pd.DataFrame, sales: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each sale: place of its client's last version with ``at`` up to its own, or -1, and how many versions its client has."""
    client, at = versions["client"].to_numpy(), versions["at"].to_numpy()
    low = np.searchsorted(client, sales["client"].to_numpy(), "left")
    end = np.searchsorted(client, sales["client"].to_numpy(), "right")
    asked, first, high = sales["at"].to_numpy(), low.copy(), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        up = np.zeros(len(mid), bool)
        up[open_] = at[mid[open_]] <= asked[open_]
        low, high = np.where(open_ & up, mid + 1, low), np.where(open_ & ~up, mid, high)
    return np.where((low > first) & (asked != NONE), low - 1, -1), end - first


def pruned(versions: pd.DataFrame, mark: int) -> pd.DataFrame:
    """Without versions up to ``mark`` but the last of each client, which is settled."""
    if not len(versions):
        return versions
    passed = versions["at"].to_numpy() <= mark
    client = versions["client"].to_numpy()
    followed = np.append((client[1:] == client[:-1]) & passed[1:], False)
    return versions.assign(settled=passed)[~(passed & followed)]


def _number(values) -> pd.array:
    values = np.asarray(values, np.int64)
    return pd.arrays.IntegerArray(values, values == NONE)


class Enricher(StatefulProcessor):
    """One key: a group of clients, or a slice of time of a hot one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        blob = StructType([StructField("rows", BinaryType())])
        self.versions = handle.getListState("versions", blob)
        self.waiting = handle.getListState("waiting", blob)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        clock = new[new["kind"] == "clock"].iloc[0]
        batch, sales_mark, changes_mark = int(clock["batch"]), int(clock["sales_mark"]), int(clock["changes_mark"])
        mark, last = min(sales_mark, changes_mark), sales_mark == HIGHEST
        changes, sales = new[new["kind"] == "change"], new[new["kind"] == "sale"][["client", "id", "at"]]

        late = changes["at"].to_numpy() < changes_mark
        fresh = changes[~late & (changes["client"].to_numpy() != NONE)][["client", "at", "seq", "id", "cents", "op"]].assign(settled=False)
        held = _unpacked(self.versions.get(), VERSION)
        versions = merged(held, fresh)
        kept = _unpacked(self.waiting.get(), SALE)
        sales = pd.concat([kept, sales], ignore_index=True) if len(kept) else sales
        due = ((sales["at"] == NONE) | (sales["at"] < mark) | last).to_numpy()

        slice_ = int(key[1])
        yield self._emitted(versions, sales[due], batch, slice_)
        if late.any():
            yield self._late(changes[late], batch)
        if slice_ != 0 and len(versions):
            yield self._summary(versions, batch, slice_)
        if last:
            self.versions.clear()
            self.waiting.clear()
            return
        left = pruned(versions, mark)
        if len(fresh) or len(left) != len(held) or not held["settled"].equals(left["settled"].reset_index(drop=True)):
            self.versions.put(_packed(left, VERSION)) if len(left) else self.versions.clear()
        if len(kept) or not due.all():
            self.waiting.put(_packed(sales[~due], SALE)) if not due.all() else self.waiting.clear()

    def _emitted(self, versions: pd.DataFrame, sales: pd.DataFrame, batch: int, slice_: int) -> pd.DataFrame:
        place, n = bisect(versions, sales)
        hit = place >= 0
        take = lambda c: np.where(hit, versions[c].to_numpy()[place], NONE) if len(versions) else np.full(len(place), NONE)
        op = np.where(hit, versions["op"].to_numpy(object)[place], None) if len(versions) else np.full(len(place), None, object)
        settled = hit & versions["settled"].to_numpy(bool)[place] if len(versions) else hit
        return pd.DataFrame({"rec": "sale", "id": _number(sales["id"]), "batch": batch, "n_held": _number(n), "change_id": _number(take("id")), "balance_cents": _number(take("cents")), "op": op, "client": _number(sales["client"]), "slice": slice_, "own": hit, "version_at": _number(take("at")), "settled": settled})

    def _late(self, changes: pd.DataFrame, batch: int) -> pd.DataFrame:
        none = _number(np.full(len(changes), NONE))
        return pd.DataFrame({"rec": "late", "id": _number(changes["id"]), "batch": batch, "n_held": none, "change_id": none, "balance_cents": none, "op": None, "client": none, "slice": 0, "own": False, "version_at": none, "settled": False})

    def _summary(self, versions: pd.DataFrame, batch: int, slice_: int) -> pd.DataFrame:
        """What other slices of the client need: versions that are not settled, whether one is, and the last."""
        v = versions.iloc[-1]
        n = int((~versions["settled"].to_numpy(bool)).sum())
        one = lambda x: _number([x])
        return pd.DataFrame({"rec": "slice", "id": one(v["id"]), "batch": batch, "n_held": one(n), "change_id": one(v["id"]), "balance_cents": one(v["cents"]), "op": [v["op"]], "client": one(v["client"]), "slice": slice_, "own": bool(versions["settled"].any()), "version_at": one(v["at"]), "settled": bool(v["settled"])})


# ---- keys ----


def hot_clients(rows: DataFrame, total: int, rows_per_key: int, pieces: int, cuts: int = 64) -> list[tuple[int, list[int], int]]:
    """(client, inner cuts of time, slices to a cut) of hot clients, at most ``pieces`` of them with ``cuts`` - 1 cuts each."""
    least = max(rows_per_key, total // pieces)
    counted = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    hot = [(r.client, r.n) for r in counted.collect()]
    if not hot:
        return []
    timed = rows.where(F.col("client").isin([c for c, _ in hot]) & (F.col("at") != NONE))
    steps = [i / cuts for i in range(1, cuts)]
    found = {r.client: r.cut for r in timed.groupBy("client").agg(F.percentile_approx("at", steps, 10_000).alias("cut")).collect()}
    out = []
    for client, n in hot:
        want = min(cuts, -(-n // rows_per_key))
        points = sorted({found[client][i * cuts // want - 1] for i in range(1, want)}) if found.get(client) else []
        out.append((client, points, max(1, -(-n // rows_per_key // (len(points) + 1)))))
    return out


HOT = "client long, cuts array<long>, subs long, first long, last long"


def keyed(rows: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """Adds bucket and slice; slice 0 is a whole group of clients, slices of hot ones follow their time, those below 0 have sales without one."""
    j = rows.join(F.broadcast(hot), "client", "left")
    cut = F.size(F.filter("cuts", lambda x: x <= F.col("at"))).cast("long")
    low = F.coalesce(F.get("cuts", (cut - 1).cast("int")), F.col("first"))
    high = F.coalesce(F.get("cuts", cut.cast("int")), F.col("last") + 1)
    sub = F.greatest(F.lit(0), F.least(F.col("subs") - 1, F.floor((F.col("at") - low).cast("double") * F.col("subs") / F.greatest(high - low, F.lit(1))))).cast("long")
    untimed = -1 - F.pmod(F.xxhash64("id"), F.col("subs") * (F.size("cuts") + 1))
    place = F.when(F.col("cuts").isNull(), 0).when(F.col("at") == NONE, untimed).otherwise(1 + cut * SUBS + sub)
    bucket = F.when(F.col("cuts").isNull(), F.pmod(F.xxhash64("client"), F.lit(buckets))).otherwise(F.col("client"))
    return j.select(bucket.alias("bucket"), place.cast("long").alias("slice"), *rows.columns)


def clock_keys(spark: SparkSession, hot: DataFrame, buckets: int) -> DataFrame:
    """Every key of ``keyed``."""
    count = F.col("subs") * (F.size("cuts") + 1)
    timed = hot.select(F.col("client").alias("bucket"), F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("cut"), "subs").select("bucket", F.explode(F.sequence(1 + F.col("cut") * SUBS, F.col("cut") * SUBS + F.col("subs"))).alias("slice"))
    untimed = hot.select(F.col("client").alias("bucket"), F.explode(F.sequence(-count, F.lit(-1).cast("long"))).alias("slice"))
    return spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("slice")).unionByName(timed).unionByName(untimed)


# ---- stream ----

#: Settings of the state store while the stream runs; RocksDB is what transformWithState asks for.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; the caller's are put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if fs.exists(path(source)) and not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def enrich(sales: DataFrame, changes: DataFrame, batches: int = 8, delay_hours: int = 12, rows_per_key: int = 10_000, pieces: int = 1000) -> DataFrame:
    """rec, id, batch, n_held, change_id, balance_cents, op of all sales and of late changes; files stay in a new folder until ``clean``."""
    spark = sales.sparkSession
    home = fresh_path(spark, "valid-time")
    rows = sale_rows(sales, batches).unionByName(change_rows(changes, batches))
    rows.write.parquet(f"{home}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{home}/rows")

    seen = {(r.kind, r.batch): (r.top, r.n, r.low) for r in rows.groupBy("kind", "batch").agg(F.max("at").alias("top"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("at") != NONE, F.col("at"))).alias("low")).collect()}  # two rows a batch
    total = sum(n for _, n, _ in seen.values())
    times = [t for top, _, low in seen.values() for t in (top, low) if t is not None and t != NONE] or [0]
    hot = spark.createDataFrame([(c, cut, subs, min(times), max(times)) for c, cut, subs in hot_clients(rows, total, rows_per_key, pieces)], HOT)
    buckets = max(1, -(-total // rows_per_key))

    def watermark(kind: str, batch: int) -> int:
        tops = [top for (k, b), (top, _, _) in seen.items() if k == kind and b < batch and top != NONE]
        return max(tops) - delay_hours * 3_600_000_000 if tops else LOWEST

    marks = [(b, watermark("sale", b), watermark("change", b)) for b in range(batches)] + [(batches, HIGHEST, HIGHEST)]
    mark = F.explode(F.array(*(F.struct(F.lit(b).alias("batch"), F.lit(s).alias("sales_mark"), F.lit(c).alias("changes_mark")) for b, s, c in marks)))
    clocks = clock_keys(spark, hot, buckets).select("bucket", "slice", mark.alias("mark")).select("bucket", "slice", "mark.*")
    number = lambda c: F.lit(NONE).alias(c)
    ticks = clocks.select("bucket", "slice", F.lit("clock").alias("kind"), number("client"), number("id"), number("at"), number("seq"), number("cents"), F.lit(None).cast("string").alias("op"), "batch", "sales_mark", "changes_mark")
    feed = keyed(rows, hot, buckets).withColumns({"sales_mark": F.lit(NONE), "changes_mark": F.lit(NONE)}).unionByName(ticks)
    feed.withColumn("turn", F.col("batch")).write.partitionBy("turn").parquet(f"{home}/staged")

    with settings(spark, STREAM):
        for b in range(batches + 1):
            _move(spark, f"{home}/staged/turn={b}", f"{home}/feed/turn={b}")
            stream = spark.readStream.schema(FEED).parquet(f"{home}/feed/turn=*")
            out = stream.groupBy("bucket", "slice").transformWithStateInPandas(Enricher(), OUT, "append", "none")
            run = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/emitted")
            run.awaitTermination()
    return owned(_resolve(spark.read.schema(OUT).parquet(f"{home}/emitted")), home)


def _resolve(out: DataFrame) -> DataFrame:
    """Rows of hot clients with what their slice could not know.

    Of the settled versions of a client only the one in its last such slice is held; earlier ones are pruned,
    and so is all before them.  What a slice's sales need is gathered in one row per slice and batch: the sum for the
    client is broadcast (a row per hot client and batch), what earlier slices carry comes from a window over
    the slices of a client that have sales or open versions.
    """
    names = ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]
    slices = out.where(F.col("rec") == "slice")
    client = slices.groupBy("client", "batch").agg((F.sum("n_held") + F.max(F.col("own").cast("long"))).alias("all_held"), F.max(F.when(F.col("own"), F.col("slice"))).alias("settled_slice"))
    client = F.broadcast(client)
    # a slice's last version counts if it is not settled or in the last settled slice
    valid = slices.join(client, ["client", "batch"]).where(~F.col("settled") | (F.col("slice") == F.col("settled_slice")))
    step = valid.select("client", "batch", "slice", F.lit(1).alias("kind"), F.struct("change_id", "balance_cents", "op").alias("carried"))

    rows = out.where(F.col("rec") != "slice")
    sliced = rows.where(F.col("slice") != 0)
    asked = sliced.select("client", "batch", "slice").distinct().withColumns({"kind": F.lit(0), "carried": F.lit(None).cast(step.schema["carried"].dataType)})
    before = Window.partitionBy("client", "batch").orderBy("slice", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = asked.unionByName(step).withColumn("carried", F.last("carried", ignorenulls=True).over(before)).where("kind = 0").drop("kind").join(client, ["client", "batch"], "left")

    joined = sliced.join(found, ["client", "batch", "slice"], "left")
    own = F.struct("change_id", "balance_cents", "op")
    held = F.when(F.col("own") & (~F.col("settled") | (F.col("slice") == F.col("settled_slice"))), own).otherwise(F.col("carried"))
    resolved = joined.select("rec", "id", "batch", F.coalesce("all_held", F.lit(0)).alias("n_held"), held.alias("held")).select("rec", "id", "batch", "n_held", "held.*")
    return rows.where(F.col("slice") == 0).select(*names).unionByName(resolved.select(*names))


def op12_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables ``sales`` and ``client_changes``: rec, id, batch, n_held, change_id, balance_cents, op (see the module's text)."""
    return enrich(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


#: The same by sets instead of state: what is held at a batch is what came with it, what the watermark of the batch before has not
#: passed, and the last of what that has passed.  The checksum of decimal digits is taken bit by bit.
OP12_SQL = """
WITH s AS (SELECT row_number() OVER () AS sid, sale_id, client_id, sold_at, cast(greatest(0, least(7, floor((datediff('day', DATE '1970-01-01', cast(arrived_at AS DATE)) - 19723) * 8 / 152))) AS BIGINT) AS b FROM sales),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(cast(change_id AS VARCHAR), ''), ''), lambda d: cast(ascii(d) AS BIGINT))),
   lambda a, d: list_reduce([xor(a, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS shift
  FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL)),
cb AS (SELECT *, CASE WHEN isfinite(balance) THEN cast(floor(100 * balance + 0.5) AS BIGINT) END AS cents, cast(greatest(0, least(7, floor((datediff('day', DATE '1970-01-01', cast(valid_at AS DATE)) + shift - 19723) * 8 / 152))) AS BIGINT) AS b FROM c),
m AS (SELECT b, (SELECT max(sold_at) FROM s WHERE s.b < t.b) - INTERVAL 12 HOUR AS ms, (SELECT max(valid_at) FROM cb WHERE cb.b < t.b) - INTERVAL 12 HOUR AS mc FROM (SELECT unnest(range(8)) AS b) t),
h AS (SELECT b, mc, CASE WHEN ms IS NOT NULL AND mc IS NOT NULL THEN least(ms, mc) END AS h FROM m),
v AS (SELECT cb.*, row_number() OVER (PARTITION BY client_id ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST, cents NULLS FIRST, coalesce(op, '')) AS rn FROM cb JOIN h USING (b) WHERE client_id IS NOT NULL AND (mc IS NULL OR valid_at >= mc)),
f AS (SELECT client_id, h.b, max(rn) AS rn FROM v JOIN h ON v.b <= h.b AND valid_at <= h.h GROUP BY ALL),
e AS (SELECT t.e, h.h AS passed FROM (SELECT unnest(range(9)) AS e) t LEFT JOIN h ON h.b = t.e - 1),
held AS (SELECT v.client_id, e.e, v.rn, valid_at, change_id, cents, op FROM v JOIN e ON v.b <= e.e LEFT JOIN f ON f.client_id = v.client_id AND f.b = e.e - 1 WHERE v.b = e.e OR passed IS NULL OR valid_at > passed OR v.rn = f.rn),
n AS (SELECT client_id, e, count(*) AS n FROM held GROUP BY ALL),
due AS (SELECT sid, any_value(s.sale_id) AS sale_id, any_value(client_id) AS client_id, any_value(sold_at) AS sold_at, CASE WHEN any_value(sold_at) IS NULL THEN any_value(s.b) ELSE coalesce(min(h.b), 8) END AS e FROM s LEFT JOIN h ON h.b >= s.b AND sold_at < h.h GROUP BY sid),
best AS (SELECT sid, due.client_id, due.e, max(rn) AS rn FROM due JOIN held ON due.client_id = held.client_id AND due.e = held.e AND valid_at <= sold_at GROUP BY ALL)
SELECT 'sale' AS rec, sale_id AS id, due.e AS batch, coalesce(n.n, 0) AS n_held, held.change_id, held.cents AS balance_cents, held.op
FROM due LEFT JOIN n ON due.client_id = n.client_id AND due.e = n.e LEFT JOIN best ON due.sid = best.sid LEFT JOIN held ON held.client_id = best.client_id AND held.e = best.e AND held.rn = best.rn
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM cb JOIN h USING (b) WHERE valid_at < mc
"""
