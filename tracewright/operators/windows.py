"""Windows over event sequences: anchored fixed-length windows, gaps and islands, bounded chunks, caps per key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import ordered
from tracewright.sources.shared import materialize


def subsessions(ev: DataFrame, keys: list[str], gap: int, ts: str = "ts") -> DataFrame:
    """Adds sub_start: a run of events with no step over `gap`. An anchor never lies before the previous event, so anchored windows do not cross such steps."""
    order = Window.partitionBy(*keys).orderBy(ts)
    fresh = F.coalesce(F.col(ts) - F.lag(ts).over(order) > gap, F.lit(True))
    return ev.withColumn("_fresh", fresh).withColumn("sub_start", F.last(F.when(F.col("_fresh"), F.col(ts)), ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def anchored_windows(ev: DataFrame, keys: list[str], gap: int, ts: str = "ts") -> DataFrame:
    """Adds window_start: events join a window while they lie within `gap` (inclusive) of its first event; the next one opens a new window.

    Only runs longer than `gap` need more than their first event as anchor. There each time points to the first one beyond its window, and the anchors are what is reachable from
    the run's start; the pointers are doubled, so the rounds grow with the logarithm of the windows in a run, and no run is gathered in one task.
    """
    marked = subsessions(ev, keys, gap, ts)
    points = marked.select(*keys, "sub_start", F.col(ts).alias("_t")).distinct()
    span = points.groupBy(*keys, "sub_start").agg((F.max("_t") - F.col("sub_start")).alias("_span")).where(F.col("_span") > gap)
    points = points.join(span.drop("_span"), [*keys, "sub_start"], "left_semi")
    longest = span.agg(F.max("_span")).first()[0]
    if longest is None:
        return marked.withColumn("window_start", F.col("sub_start")).drop("sub_start")
    run = [*keys, "sub_start"]
    targets = points.select(*run, F.col("_t").alias("_at"), F.lit(0).alias("_kind"), F.col("_t").alias("_to"), F.lit(None).cast("long").alias("_from"))
    probes = points.select(*run, (F.col("_t") + gap + 1).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_to"), F.col("_t").alias("_from"))
    back = Window.partitionBy(*run).orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    jumps = targets.unionByName(probes).withColumn("_next", F.last("_to", ignorenulls=True).over(back)).where("_from is not null and _next is not null").select(*run, F.col("_from").alias("_t"), "_next")
    jumps = materialize(jumps, "jumps")
    reached = span.select(*run, F.col("sub_start").alias("_t"))
    rounds = math.ceil(math.log2(longest / max(gap, 1) + 2))
    for k in range(rounds):
        reached = materialize(reached.unionByName(reached.join(jumps, [*run, "_t"]).select(*run, F.col("_next").alias("_t"))).distinct(), "anchors")
        if k + 1 < rounds:
            twice = jumps.select(*run, F.col("_t").alias("_next"), F.col("_next").alias("_after"))
            jumps = materialize(jumps.join(twice, [*run, "_next"]).select(*run, "_t", F.col("_after").alias("_next")), "jumps")
    anchors = reached.select(*keys, F.col("_t").alias(ts), F.lit(True).alias("_anchor"))
    order = Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    flagged = marked.join(anchors, [*keys, ts], "left").withColumn("_anchor", F.coalesce("_anchor", F.col(ts) == F.col("sub_start")))
    return flagged.withColumn("window_start", F.last(F.when(F.col("_anchor"), F.col(ts)), ignorenulls=True).over(order)).select(*ev.columns, "window_start")


def islands(df: DataFrame, keys: list[str], ts: str, step: int, widen: int, part: int = ordered.PART) -> DataFrame:
    """Gaps and islands: keys, from_ts, to_ts of runs of times at most `step` apart, each end moved out by `widen`. Keys of more than `part` rows are cut into stretches of time."""
    times = df.select(*keys, F.col(ts).alias("_t")).withColumn("_last", F.col("_t"))
    flagged = ordered.carried(times, keys, [F.col("_t")], ["_last"], inclusive=False, part=part)
    started = flagged.withColumn("_start", F.when(F.coalesce(F.col("_t") - F.col("_last") > step, F.lit(True)), F.col("_t"))).drop("_last")
    runs = ordered.carried(started, keys, [F.col("_t"), F.col("_start").asc_nulls_last()], ["_start"], part=part)
    return runs.groupBy(*keys, "_start").agg((F.min("_t") - widen).alias("from_ts"), (F.max("_t") + widen).alias("to_ts")).drop("_start")


def dirty_windows(unbuilt: DataFrame, gap: int, keys: tuple[str, ...] = ("entity_id",), ts: str = "ts") -> DataFrame:
    """Spans to rebuild for events not yet built: clusters of steps up to twice the gap, widened by it."""
    return islands(unbuilt, list(keys), ts, 2 * gap, gap)


def affected_subsessions(ev: DataFrame, dirty: DataFrame, keys: list[str], gap: int, ts: str = "ts", entity: str = "entity_id", part: int = ordered.PART) -> DataFrame:
    """Events of every whole run that a dirty span touches: the exact unit of a rebuild.

    One sweep per entity: spans pass by their beginning and runs by their end, and a run is hit if the furthest end of the spans passed reaches its beginning. A span is one row, however long.
    """
    runs = subsessions(ev, keys, gap, ts)
    bounds = runs.groupBy(*keys, "sub_start").agg(F.max(ts).alias("_t"))
    rest = [k for k in keys if k != entity]
    spans = dirty.select(entity, F.col("from_ts").alias("_t"), F.lit(0).alias("_kind"), F.col("to_ts").alias("_reach"))
    swept = spans.unionByName(bounds.select(entity, "_t", F.lit(1).alias("_kind"), *rest, "sub_start"), allowMissingColumns=True)
    passed = ordered.carried(swept, [entity], [F.col("_t"), F.col("_kind")], ["_reach"], how="max", part=part)
    hit = passed.where((F.col("_kind") == 1) & (F.col("_reach") >= F.col("sub_start"))).select(*keys, "sub_start")
    return runs.join(hit, [*keys, "sub_start"], "left_semi").select(*ev.columns)


def chunk(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds chunk: the number, from 0, of the piece of `size` rows that a row falls in."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def cap_per_key(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key in order: a top-k report."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def majority(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value per key; ties go to the one seen first."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(seq).alias("_first"))
    least = F.struct(-F.col("_n"), F.col("_first"))
    return counted.groupBy(*keys).agg(F.min_by(value, least).alias(value))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 12) -> DataFrame:
    """keys, bin (0 to bins - 1), low, high, n: equal widths between a key's extremes, the last bin closed; width 1 where all values are equal."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    placed = df.where(F.col(value).isNotNull()).join(ends, keys).withColumn("_w", width).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.col("_w"))).cast("int"))
    counted = placed.groupBy(*keys, "bin", "_lo", "_w").agg(F.count("*").alias("n"))
    return counted.select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")
