"""Registered queries on streams, each with its DuckDB twin: the events table is read as a stream of files until all that is there has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.plans.behaviour import windows_sql
from tracewright.sources import fixtures as X
from tracewright.sources.buckets import read_state
from tracewright.sources.shared import scratch
from tracewright.streaming import jobs

GAP = 86400
LATENESS = 2 * 86400


def _events(spark, d):
    return jobs.with_watermark(X.stream(spark, d), f"{LATENESS} seconds")


def _run(df, label):
    path = scratch(df.sparkSession, label)
    jobs.write_stream(df, path, scratch(df.sparkSession, f"{label}-checkpoint")).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def i18_ingest(spark, d):
    """Events as they were landed, each once."""
    silver, late = scratch(spark, "silver"), scratch(spark, "late")
    jobs.land_with_late_rows(_events(spark, d), silver, late, scratch(spark, "ingest-checkpoint"), LATENESS).awaitTermination()
    return spark.read.parquet(silver).select("event_id", "entity_id", "wallet", "chain", "ts", F.round("usd_value", 6).alias("usd_value"))


def i18_windows(spark, d):
    """Anchored windows that the watermark has closed by the end of the table."""
    return _run(jobs.stream_windows(_events(spark, d), GAP), "stream-windows")


def i18_rebuild(spark, d):
    """Anchored windows kept batch by batch, late rows included."""
    silver, late, path = (scratch(spark, x) for x in ("silver", "late", "kept-windows"))
    jobs.keep_windows(_events(spark, d), silver, late, path, scratch(spark, "rebuild-checkpoint"), LATENESS, GAP).awaitTermination()
    return read_state(spark, path, jobs.WINDOW).select("entity_id", "wallet", "window_start", "end_ts", "n")


def i19_rates(spark, d):
    """Sliding rates of the windows that the watermark has closed."""
    found = _run(jobs.stream_rates(_events(spark, d), "1 day", "12 hours"), "stream-rates")
    return found.select("entity_id", "from_ts", "to_ts", "n", F.round("usd", 4).alias("usd"))


QUERIES = {"i18_ingest": i18_ingest, "i18_windows": i18_windows, "i18_rebuild": i18_rebuild, "i19_rates": i19_rates}

ORACLES = {
    "i18_ingest": f"WITH {X.EV} SELECT event_id, entity_id, wallet, chain, ts, round(usd_value, 6) AS usd_value FROM ev",
    "i18_windows": f"WITH {windows_sql(GAP)} SELECT entity_id, wallet, window_start, max(ts) AS end_ts, count(*) AS n FROM win GROUP BY ALL HAVING window_start + {GAP} < (SELECT max(ts) FROM ev) - {LATENESS}",
    "i18_rebuild": f"WITH {windows_sql(GAP)} SELECT entity_id, wallet, window_start, max(ts) AS end_ts, count(*) AS n FROM win GROUP BY ALL",
    "i19_rates": f"""WITH {X.EV}, w AS (SELECT *, unnest([ts // 43200 * 43200, (ts // 43200 - 1) * 43200]) AS from_ts FROM ev)
      SELECT entity_id, from_ts, from_ts + 86400 AS to_ts, count(*) AS n, round(sum(usd_value), 4) AS usd FROM w GROUP BY ALL HAVING from_ts + 86400 <= (SELECT max(ts) FROM ev) - {LATENESS}""",
}
