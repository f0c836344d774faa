"""Streams of observations: idempotent ingest, windowed volumes, first crossings of a threshold.

Each job takes a streaming DataFrame with an event-time column, so that any source will do, and
has a batch twin that gives the same table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from palimpsest.operators.ledger import append_ledger


def stream_append(rows: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], clock: str = "observed_at", delay: str = "40 days") -> StreamingQuery:
    """Appends each micro-batch's new rows to a ledger: repeats inside the watermark go before they reach it, older ones by the anti-join with it. A batch that is run again adds nothing."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in key)

    def put(batch: DataFrame, _: int) -> None:
        append_ledger(batch, path, key, order, clock)

    # rows with a null part in their key are never repeats, so they go round the state
    fresh = rows.withColumn("_own", F.when(F.expr(whole), F.concat_ws("\x1f", *key)).otherwise(F.concat_ws("\x1f", F.lit("\x00"), *order)))
    return fresh.withWatermark(clock, delay).dropDuplicatesWithinWatermark(["_own"]).drop("_own").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volumes(rows: DataFrame, channel: str, clock: str, width: str, slide: str | None = None) -> DataFrame:
    """(channel, start, n) of tumbling, or with slide sliding, windows; for streams and tables alike."""
    w = F.window(clock, width, slide) if slide else F.window(clock, width)
    return rows.groupBy(channel, w.alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(channel, F.col("_w.start").alias("start"), "n")


def stream_volume(rows: DataFrame, path: str, checkpoint: str, channel: str, clock: str, width: str, slide: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Windowed volumes as Parquet: a window is written once, when the watermark (the latest row less `delay`) has passed its end, and then leaves the state. Windows still open are not written; late rows are left out and told by late_rows."""
    seen = rows.observe("seen", F.count(F.lit(1)).alias("n"))
    out = volumes(seen.withWatermark(clock, delay), channel, clock, width, slide)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class KeptProgress(StreamingQueryListener):
    """Keeps what each batch of a query saw, a small file a batch below a folder of any file system: progress that a session holds goes with it, and after a hundred batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("seen")
        line = json.dumps({"query_id": str(p.id), "batch": p.batchId, "input_rows": p.numInputRows, "seen": seen["n"] if seen else 0, "dropped_groups": sum(op.numRowsDroppedByWatermark for op in p.stateOperators)})
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.id}-{p.batchId:09d}.json")
        out = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray(line.encode()))
        out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def kept_progress(spark: SparkSession, folder: str) -> Iterator[None]:
    """Queries that run inside leave their batches' counts in the folder."""
    listener = KeptProgress(spark, folder)
    spark.streams.addListener(listener)
    try:
        yield
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)


def late_rows(spark: SparkSession, folder: str, path: str, checkpoint: str) -> DataFrame:
    """One row (seen, written, waiting, late) of a stream of tumbling volumes: every row seen is in a window that was written, in one that waits in the state, or was late. A batch that was run again counts once."""
    kept = spark.read.schema("query_id string, batch long, seen long").json(folder).groupBy("query_id", "batch").agg(F.max("seen").alias("seen")).agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"))
    written = spark.read.schema("n long").parquet(path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("written"))
    state = spark.read.format("statestore").load(checkpoint)
    waiting = state.agg(F.coalesce(F.sum(F.col("value")[state.schema["value"].dataType.names[-1]]), F.lit(0)).alias("waiting"))
    return kept.crossJoin(written).crossJoin(waiting).withColumn("late", F.col("seen") - F.col("written") - F.col("waiting"))  # one row each


def late_groups(run: StreamingQuery) -> int:
    """How much the watermark dropped in a run's recent batches: late rows, counted once for each channel and window that a task had put them into."""
    return sum(op["numRowsDroppedByWatermark"] for batch in run.recentProgress for op in batch["stateOperators"])


TRIGGERS = "person_id long, triggered_at timestamp, total double"


def crossings(rows: DataFrame, entity: str, weight: str, threshold: float, clock: str, tie: str) -> DataFrame:
    """(person_id, triggered_at, total): the first row at which an entity's running sum, in event time, reaches the threshold."""
    order = Window.partitionBy(entity).orderBy(clock, tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.filter(F.col(entity).isNotNull()).withColumn("_s", F.round(F.sum(weight).over(order), 6)).filter(F.col("_s") >= threshold)
    return summed.groupBy(entity).agg(F.min_by(F.struct(clock, "_s"), F.struct(clock, tie)).alias("_f")).select(F.col(entity).cast("long").alias("person_id"), F.col(f"_f.{clock}").alias("triggered_at"), F.round("_f._s", 6).alias("total"))


#: A row that waits: its time in microseconds, its id and its weight.
WAITING = np.dtype([("at", "<i8"), ("id", "<i8"), ("weight", "<f8")])


def packed(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), WAITING)
    out["at"], out["id"], out["weight"] = rows["observed_at"].to_numpy().astype("datetime64[us]").astype(np.int64), rows["observation_id"].to_numpy(), rows["weight"].to_numpy()
    return out


class Crossing(StatefulProcessor):
    """Adds a key's rows in event-time order, as the watermark passes them, until their sum reaches the threshold; then tells it once.

    State: one value with the sum so far, the time at which it was told (null before), and the rows that still wait, packed (none once it was told),
    so that a key costs one read and one write a batch. A timer stands at the earliest of these rows. With `remember` a key that fired is forgotten so many
    days later, and could then fire anew; else it is kept for good.
    """

    def __init__(self, threshold: float, remember_days: int | None = None):
        self.threshold, self.remember_ms = threshold, None if remember_days is None else remember_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "total double, fired_at long, waiting binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, fired_at, waiting = self.held.get() or (0.0, None, b"")
        new = [packed(pdf) for pdf in rows if len(pdf)]
        if new and fired_at is None:
            self.held.update((total, None, bytes(waiting) + b"".join(x.tobytes() for x in new)))
            self.handle.registerTimer(min(int(x["at"].min()) for x in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, fired_at, waiting = self.held.get() or (0.0, None, b"")
        if fired_at is not None:  # a timer of an earlier batch may be left as well as the one that forgets it
            if self.remember_ms is not None and expiredTimerInfo.getExpiryTimeInMs() >= fired_at // 1000 + self.remember_ms:
                self.held.clear()
            return
        limit = 1000 * timerValues.getCurrentWatermarkInMs()
        rows = np.sort(np.frombuffer(bytes(waiting), WAITING))
        n = int(np.searchsorted(rows["at"], limit, side="right"))
        for at, w in zip(rows["at"][:n].tolist(), rows["weight"][:n].tolist()):
            total = round(total + w, 6)
            if total >= self.threshold:
                self.held.update((total, at, b""))
                if self.remember_ms is not None:
                    self.handle.registerTimer(at // 1000 + self.remember_ms)
                yield pd.DataFrame({"person_id": [key[0]], "triggered_at": [pd.Timestamp(at, unit="us")], "total": [total]})
                return
        self.held.update((total, None, rows[n:].tobytes()))
        if n < len(rows):
            self.handle.registerTimer(int(rows["at"][n]) // 1000)

    def close(self) -> None:
        pass


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_trigger(rows: DataFrame, path: str, checkpoint: str, threshold: float, delay: str = "1 day", remember_days: int | None = None) -> StreamingQuery:
    """The crossings of a stream (person_id, observed_at, observation_id, weight), once each, as Parquet.

    A key's rows wait in state until the watermark has passed them, and are then added in event-time order (see Crossing). Rows later than
    the watermark are dropped by it, and rows it hasn't passed when the input ends stay in the checkpoint. A restart goes on from there and tells nothing twice.
    """
    spark = rows.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # state variables live in this store alone; a query keeps the one it began with
    try:
        keyed = rows.filter("person_id IS NOT NULL").withWatermark("observed_at", delay).groupBy("person_id")
        out = keyed.transformWithStateInPandas(Crossing(threshold, remember_days), TRIGGERS, "Append", "EventTime")
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
