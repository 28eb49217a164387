"""Structured Streaming: event ingest with late rows set aside, windowed rates, anchored windows as keyed state, and aggregates and windows kept by micro-batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from tracewright.operators import incremental as I
from tracewright.operators import windows as W
from tracewright.sources.buckets import BUCKETS, read_state, update_state
from tracewright.sources.shared import path_exists

EVENT = (
    "event_id string, entity_id string, wallet string, chain string, ts long, k int, action_type string, cex_id string, project_id string, cate_id string, usd_value double, "
    "primary_asset_key string, counterparty string"
)
ACCOUNT = ["entity_id", "wallet"]
#: State store that timers and keyed state of any size need.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DAY = 86400


def with_watermark(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Streamed events, each event_id once, with event_time and a watermark of `lateness`."""
    return events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stream_events(spark: SparkSession, path: str, schema: str = EVENT, lateness: str = "2 days", per_trigger: int = 1) -> DataFrame:
    """Events from files as they land."""
    return with_watermark(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path), lateness)


def stream_rates(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Events and value per entity in tumbling windows, or sliding ones."""
    window = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    counted = events.groupBy(window.alias("w"), "entity_id").agg(F.count("*").alias("n"), F.sum("usd_value").alias("usd"))
    return counted.select("entity_id", F.unix_timestamp("w.start").alias("from_ts"), F.unix_timestamp("w.end").alias("to_ts"), "n", "usd")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now, and what the watermark then releases, to Parquet files, with state in RocksDB, of which each batch stores its changes only."""
    spark = df.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _Anchored(StatefulProcessor):
    """Times of an account that the watermark has not passed yet, and its open window."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long")
        self.window = handle.getValueState("window", "window_start long, end_ts long, n long")

    def close(self) -> None:
        pass

    def _wake(self, times: list[int], window: tuple | None) -> None:
        """The next time that something can be settled: the first time waiting, or the end of the window's reach."""
        ahead = [*times[:1], *([window[0] + self.gap] if window else [])]
        if ahead:
            self.handle.registerTimer(1000 * min(ahead))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ts),) for part in rows for ts in part["ts"]]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(1000 * min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        times = sorted(t[0] for t in self.waiting.get()) if self.waiting.exists() else []
        window = tuple(self.window.get()) if self.window.exists() else None
        settled = [t for t in times if 1000 * t < mark]
        times, out = times[len(settled) :], []
        for t in settled:
            if window and t - window[0] <= self.gap:
                window = (window[0], t, window[2] + 1)
            else:
                out += [window] if window else []
                window = (t, t, 1)
        if window and 1000 * (window[0] + self.gap) < mark:
            out.append(window)
            window = None
        self.waiting.put([(t,) for t in times]) if times else self.waiting.clear()
        self.window.update(window) if window else self.window.clear()
        self._wake(times, window)
        yield pd.DataFrame([(*key, *w) for w in out], columns=[*ACCOUNT, "window_start", "end_ts", "n"])


def stream_windows(events: DataFrame, gap: int) -> DataFrame:
    """Anchored windows per account: entity_id, wallet, window_start, end_ts, n, each once, when the watermark has passed all that could still join it.

    Times wait until the watermark passes them, so rows may come in any order within the lateness. Timers settle them; an account without open window or waiting times has no state. Rows behind the
    watermark are dropped here: keep_windows() takes those in. Needs the RocksDB state store, as write_stream() sets it.
    """
    schema = "entity_id string, wallet string, window_start long, end_ts long, n long"
    return events.select(*ACCOUNT, "ts", "event_time").groupBy(*ACCOUNT).transformWithStateInPandas(_Anchored(gap), schema, "Append", "EventTime")


def _newest_before(spark: SparkSession, ledger: str, number: int) -> int | None:
    """The newest event time of the batches before this one, from a ledger of one row per batch."""
    if not path_exists(spark, ledger):
        return None
    return spark.read.schema("newest long, number long").parquet(ledger).where(F.col("number") < number).agg(F.max("newest")).first()[0]


def land(batch: DataFrame, number: int, silver: str, late: str, lateness_s: int) -> None:
    """Adds a batch to `silver` by day; rows more than lateness_s behind the newest event of the batches before also go to `late`. Run again, a batch replaces its own files. Silver is not read."""
    spark, ledger = batch.sparkSession, f"{silver.rstrip('/')}_newest"
    newest = _newest_before(spark, ledger, number)
    if newest is not None:
        batch.where(F.col("ts") < newest - lateness_s).write.mode("overwrite").parquet(f"{late}/number={number}")
    tagged = batch.withColumns({"day": F.floor(F.col("ts") / DAY), "batch": F.lit(number)})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(silver)
    batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{ledger}/number={number}")


def _each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            step(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land_with_late_rows(events: DataFrame, silver: str, late: str, checkpoint: str, lateness_s: int) -> StreamingQuery:
    """land() for every batch of a stream."""
    return _each_batch(events, lambda batch, number: land(batch, number, silver, late, lateness_s), checkpoint)


WINDOW = "entity_id string, wallet string, run_start long, run_end long, window_start long, end_ts long, n long"


def rebuild_windows(rows: DataFrame, silver: str, path: str, gap: int, number: int, buckets: int = BUCKETS) -> list[int]:
    """Brings the anchored windows kept at `path` up to date with rows that have landed in `silver`, early or late; returns the buckets rewritten.

    The rows' surroundings are the spans to rebuild; every run that a span touches is built anew from silver, of which only the days that such runs reach are read; and the account's old windows within a
    rebuilt run give way to the new ones. A batch number that a bucket holds already changes nothing there.
    """
    spark = rows.sparkSession
    spans = W.dirty_windows(rows.select("entity_id", "ts"), gap)
    low, high = spans.agg(F.min("from_ts"), F.max("to_ts")).first()
    if low is None:
        return []
    near = read_state(spark, path, WINDOW).where((F.col("run_end") >= low) & (F.col("run_start") <= high)).agg(F.min("run_start"), F.max("run_end")).first()
    low, high = min(low, low if near[0] is None else near[0]), max(high, high if near[1] is None else near[1])
    landed = spark.read.parquet(silver).where(F.col("day").between(low // DAY, high // DAY)).select(*ACCOUNT, "ts")
    runs = W.subsessions(W.affected_subsessions(landed, spans, ACCOUNT, gap), ACCOUNT, gap).withColumnRenamed("sub_start", "run_start")
    ends = runs.groupBy(*ACCOUNT, "run_start").agg(F.max("ts").alias("run_end"))
    placed = W.anchored_windows(runs, ACCOUNT, gap).groupBy(*ACCOUNT, "run_start", "window_start").agg(F.max("ts").alias("end_ts"), F.count("*").alias("n"))
    built = placed.join(ends, [*ACCOUNT, "run_start"])

    def replace(old: DataFrame, new: DataFrame) -> DataFrame:
        spans = new.select(*[F.col(c).alias(f"_{c}") for c in ACCOUNT], F.col("run_start").alias("_from"), F.col("run_end").alias("_to")).distinct()
        inside = (F.col("entity_id") == F.col("_entity_id")) & (F.col("wallet") == F.col("_wallet")) & F.col("window_start").between(F.col("_from"), F.col("_to"))
        return old.join(spans, inside, "left_anti").unionByName(new)

    return update_state(built, path, WINDOW, ACCOUNT, replace, number, buckets)


def keep_windows(events: DataFrame, silver: str, late: str, path: str, checkpoint: str, lateness_s: int, gap: int, buckets: int = BUCKETS) -> StreamingQuery:
    """Lands every batch and rebuilds the windows that it touches, late rows included: after each batch the windows at `path` are those of all that has landed."""

    def step(batch: DataFrame, number: int) -> None:
        land(batch, number, silver, late, lateness_s)
        rebuild_windows(batch, silver, path, gap, number, buckets)

    return _each_batch(events, step, checkpoint)


STATE = "pattern_key string, entity_id string, pattern string, intent_label string, asset_key string, horizon_seconds int, n long, sum_return double, sum_sq_return double, negative_count long, positive_count long, mean_return double, maturity string"


def keep_aggregates(observations: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges each micro-batch of observations into the aggregates at `path` (read_state(spark, path, STATE)); a batch rewrites the buckets of its own groups only, and changes nothing when it is run again."""
    return _each_batch(observations, lambda batch, number: update_state(I.aggregate(batch), path, STATE, ["pattern_key"], I.merge_aggregates, number, buckets), checkpoint)


def last_progress(query: StreamingQuery) -> dict:
    """The last trigger's counts: rows in, rows dropped by the watermark, rows of state."""
    progress = query.lastProgress
    data = progress if isinstance(progress, dict) else json.loads(progress.json) if progress else {}
    states = data.get("stateOperators", [])
    return {"rows": data.get("numInputRows", 0), "late": sum(s.get("numRowsDroppedByWatermark", 0) for s in states), "state": sum(s.get("numRowsTotal", 0) for s in states)}
