"""Streaming ingestion of logs: label counts over files as they come, a ledger of processed keys, and one of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.match import NOT_FOUND, Rule, first_label


def stream_log(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def label_counts(messages: DataFrame, rules: list[Rule]) -> DataFrame:
    """messages: message.  Running counts per first matching rule."""
    return messages.select(F.coalesce(first_label(F.col("message"), rules), F.lit(NOT_FOUND)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def run_available(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Process all that is there and stop; each batch's table replaces the last one below ``out``."""
    query = (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def new_keys(rows: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key: the ledger of a stream.

    It forgets nothing, so its state grows with the keys; with ``time`` a key is forgotten once the watermark passes it.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


HELD = ("key", "place", "small", "large", "last")
#: The state store that transformWithState asks for.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Stands for a null place; it comes last, as in ``coverage.attempts``.
LAST = 2**63 - 1


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(held, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class AttemptLedger(StatefulProcessor):
    """Per key the first places in order, ``most`` of them, each with what its two attempts gave; a group of keys is one entry of the state.

    Rows may come in any order and in any batches: a place that comes late pushes out the last one held, so the state
    is what all rows so far give.  With ``idle_ms``, a key is forgotten once the watermark is that far past its last row; a group has a
    timer for the key that goes first.  A call and an access to the state cost milliseconds, so they are paid per group and batch.
    """

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def _held(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(self.held.get()[0]).read_pandas() if self.held.exists() else None

    def _keep(self, held: pd.DataFrame) -> None:
        self.held.update((_packed(held),)) if len(held) else self.held.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if len(held):
                self.handle.registerTimer(int(held["last"].min()) + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, touched = self._held(), []
        for new in rows:
            touched.append(new["key"].unique())
            new = new[list(HELD)]
            held, first, size = self._first(new if held is None else pd.concat([held, new], ignore_index=True))
        if not touched:
            return
        self._keep(held)
        small, none = held["small"].to_numpy(bool), self.most + 1
        place = np.arange(len(held)) - np.repeat(first, size) + 1
        at = np.minimum.reduceat(np.where(small | held["large"].to_numpy(bool), place, none), first)
        solved = at < none
        out = pd.DataFrame({"key": held["key"].to_numpy()[first], "tried": np.where(solved, at, size), "at": np.where(solved, at, 0), "small": solved & small[first + np.where(solved, at, 1) - 1]})
        yield out[out["key"].isin(np.concatenate(touched))].assign(bucket=int(key[0]))[["bucket", "key", "tried", "at", "small"]]

    def _first(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """The first places of each key in order, where keys begin, and how many places they have."""
        rows = rows.sort_values(["key", "place", "small", "large"], ignore_index=True)
        key = rows["key"].to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(rows)))
        rows["last"] = np.repeat(np.maximum.reduceat(rows["last"].to_numpy(), first), size)
        kept = rows[np.arange(len(rows)) - np.repeat(first, size) < self.most].reset_index(drop=True)
        size = np.minimum(size, self.most)
        return kept, np.cumsum(size) - size, size

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held is not None:
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            self._keep(held[held["last"] + self.idle_ms > now])
        yield from ()


def attempts(rows: DataFrame, key_type: str = "long", most: int = 3, time: str | None = None, delay: str = "1 hour", idle_ms: int = 86_400_000, buckets: int = 1000) -> DataFrame:
    """``coverage.attempts`` over a stream: rows have key, place (their order), small and large (whether that attempt succeeded; null is no).

    A row for each key and batch that it had rows in: key, n_small, n_large, solved_by, solved_at; that of a key's last batch stands.
    Nothing is forgotten unless ``time`` names a column of event times: then rows later than ``delay`` are left out and keys idle for ``idle_ms`` go.
    Keys fall into ``buckets`` groups, which a task holds one at a time: some 10,000 rows to each and batch are quick.  One checkpoint, one number.
    The session must name the state store of ``ROCKSDB``.
    """
    if time is not None:
        rows = rows.withColumn("at", F.col(time)).withWatermark("at", delay)
    # in pandas a null would make numbers of the others inexact, so the null key has a group of its own and any value
    any_key = F.lit({"string": "", "date": "1970-01-01", "timestamp": "1970-01-01"}.get(key_type, 0)).cast(key_type)
    given = rows.select(
        F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("long").alias("bucket"), F.coalesce("key", any_key).alias("key"), F.coalesce(F.col("place").cast("long"), F.lit(LAST)).alias("place"),
        *(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("small", "large")), *([F.unix_millis("at").alias("last"), "at"] if time is not None else [F.lit(0).cast("long").alias("last")]),
    )
    ledger = AttemptLedger(most, idle_ms if time is not None else None)
    found = given.groupBy("bucket").transformWithStateInPandas(ledger, f"bucket long, key {key_type}, tried long, at long, small boolean", "update", "none" if time is None else "eventTime")
    solved = F.col("at") > 0
    return found.select(
        F.when(F.col("bucket") >= 0, F.col("key")).alias("key"), F.col("tried").alias("n_small"), (F.col("tried") - F.col("small").cast("long")).alias("n_large"),
        F.when(solved, F.when(F.col("small"), "small").otherwise("large")).alias("solved_by"), F.when(solved, F.col("at")).alias("solved_at"),
    )


def latest(found: DataFrame) -> DataFrame:
    """The last row of each key in what ``collect_updates`` wrote."""
    names = [c for c in found.columns if c not in ("key", "batch")]
    return found.groupBy("key").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("key", "s.*")


def collect_updates(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append what each batch changes to ``out``, each batch in a folder of its own so that a repeated one replaces itself; process all that is there and stop."""
    query = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination()
