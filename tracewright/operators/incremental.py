"""Incremental analysis: mergeable aggregates, checkpoints, maturity and the change feed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import ordered
from tracewright.operators.stats import accuracy, bh_qvalues, bootstrap_ci, holdout, in_halves, intervals, shrink, sign_test, summary
from tracewright.sources.shared import BROADCAST_ROWS, discard, materialize, small, spread

KEY = ["pattern_key", "entity_id", "pattern", "intent_label", "asset_key", "horizon_seconds"]
SUMS = ["n", "sum_return", "sum_sq_return", "negative_count", "positive_count"]
#: Sample sizes at which a group's statistics are kept.
MILESTONES = (10, 25, 50, 100, 200, 500, 1000)
#: Of the intervals' random numbers; rows of a group up to which a task holds its values.
SEED, HELD = 42, 1_000_000


def pattern_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)


def observation_key(episode: Column, asset: Column, horizon: Column, pattern: Column, layer: str) -> Column:
    parts = [episode, asset, horizon.cast("string"), pattern]
    return F.sha2(F.concat_ws("|", *([F.lit("primary")] if layer == "primary" else []), *parts), 256)


def new_observations(ep: DataFrame, labels: DataFrame, seen: DataFrame, layer: str = "primary", from_ts: int | None = None, to_ts: int | None = None, batch: int | None = None, dealt: bool = False) -> DataFrame:
    """Observations not yet taken: one per (episode, asset, horizon) with a return and pattern of the episode. The primary layer ignores intent, the secondary needs it. A batch takes the oldest.

    dealt: observations of an entity, asset and pattern are brought to one task before horizons and keys multiply them, so that what groups or sorts them by all of KEY moves no rows again.
    """
    own = ep if layer == "primary" else ep.where(F.col("intent_label").isNotNull())
    own = own if from_ts is None else own.where(F.col("start_ts") >= from_ts)
    own = own if to_ts is None else own.where(F.col("start_ts") <= to_ts)
    pairs = labels.where("simple_return is not null").select("episode_id", "asset_key", "horizon_seconds", F.col("simple_return").alias("return_value"))
    known = seen.select("episode_id", "asset_key", "horizon_seconds").distinct()
    if dealt and batch is None:
        left = pairs.join(known, known.columns, "left_anti").groupBy("episode_id", "asset_key").agg(F.collect_list(F.struct("horizon_seconds", "return_value")).alias("_returns"))
        held = left.join(own.select("episode_id", "entity_id", "intent_label", "start_ts", "patterns"), "episode_id").withColumn("pattern", F.explode("patterns")).drop("patterns")
        each = spread(held, "entity_id", "asset_key", "pattern").select("*", F.inline("_returns"))
    else:
        fresh = pairs.join(own.drop("asset_key"), "episode_id").join(known, known.columns, "left_anti")
        fresh = fresh if batch is None else fresh.orderBy("start_ts", "episode_id", "horizon_seconds", "asset_key").limit(batch)
        each = fresh.withColumn("pattern", F.explode("patterns"))
    intent = F.lit("") if layer == "primary" else F.col("intent_label")
    each = each.withColumn("intent_label", intent)
    return each.select(
        observation_key(F.col("episode_id"), F.col("asset_key"), F.col("horizon_seconds"), F.col("pattern"), layer).alias("observation_key"), F.lit(layer).alias("layer"), "episode_id", "entity_id", "pattern", "intent_label", "asset_key",
        "horizon_seconds", F.col("start_ts").alias("episode_ts"), "return_value", pattern_key(F.col("entity_id"), F.col("pattern"), F.col("intent_label"), F.col("asset_key"), F.col("horizon_seconds")).alias("pattern_key"),
    )


def aggregate(obs: DataFrame) -> DataFrame:
    """Mergeable state of each group: counts and sums only."""
    r = F.col("return_value")
    return obs.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(r).alias("sum_return"), F.sum(r * r).alias("sum_sq_return"), F.count_if(r < 0).alias("negative_count"), F.count_if(r > 0).alias("positive_count"))


def merge_aggregates(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Two states of the same groups as one, with the mean; a group of 20 has left the EARLY stage."""
    both = state.select(*KEY, *SUMS).unionByName(delta.select(*KEY, *SUMS)).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])
    return both.withColumn("mean_return", F.col("sum_return") / F.col("n")).withColumn("maturity", F.when(F.col("n") >= 20, "PROMISING").otherwise("EARLY"))


def rebuild_groups(state: DataFrame, obs: DataFrame, dirty: DataFrame) -> DataFrame:
    """State in which the dirty groups are counted anew from their observations; a group without any is gone."""
    return state.select(*KEY, *SUMS).join(dirty, "pattern_key", "left_anti").unionByName(aggregate(obs.join(dirty, "pattern_key", "left_semi")))


def drop_stale(obs: DataFrame, ep: DataFrame) -> DataFrame:
    """Observations whose episode is still there."""
    return obs.join(ep.select("episode_id").distinct(), "episode_id", "left_semi")


def dirty_keys(obs: DataFrame, changed: DataFrame) -> DataFrame:
    """Groups that a changed episode has observations in."""
    return obs.join(changed.select("episode_id"), "episode_id", "left_semi").select("pattern_key").distinct()


def _keys(obs: DataFrame) -> list[str]:
    """What groups are told by: pattern_key, and the columns that it is made of where they are there, by some of which the rows may be dealt already."""
    return [c for c in KEY if c in obs.columns]


def checkpoints(obs: DataFrame, marks: tuple[int, ...] = MILESTONES, samples: int = 500, at_most: int | None = None) -> DataFrame:
    """pattern_key, n, mean_return, median_return, negative_rate, ci_low, ci_high, maturity of the first n observations by time, for every milestone reached. Without samples there are no interval columns.

    Of a group, no more values than the last milestone are held together. at_most: as in ordered.segmented().
    """
    keys = _keys(obs)
    placed = ordered.positions(obs.select(*keys, "episode_ts", "observation_key", "return_value"), keys, ["episode_ts", "observation_key"], at_most=at_most)
    reached = placed.where((F.col("_i") <= max(marks)) & (F.col("_n") >= min(marks))).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "return_value"))), lambda x: x["return_value"]).alias("_values"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            starts, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            for mark in marks:
                at = np.flatnonzero(sizes >= mark)
                for part in np.array_split(at, max(1, len(at) * mark // 500_000)):
                    if len(part):
                        first = flat[starts[part][:, None] + np.arange(mark)]
                        ranked = np.sort(first, axis=1)
                        low, high = intervals(ranked, samples, SEED) if samples else (np.zeros(len(part)),) * 2
                        columns = [np.full(len(part), mark), first.mean(axis=1), (ranked[:, (mark - 1) // 2] + ranked[:, mark // 2]) / 2, (first < 0).mean(axis=1), low, high]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), *map(pa.array, columns)], names=["pattern_key", *names])

    names = ["n", "mean_return", "median_return", "negative_rate", "ci_low", "ci_high"]
    found = reached.select("pattern_key", "_values").mapInArrow(measure, "pattern_key string, n long, " + ", ".join(f"{c} double" for c in names[1:]))
    found = found.withColumn("n", F.col("n").cast("int")).withColumn("maturity", F.when(F.col("n") < 20, "EARLY").otherwise("PROMISING"))
    return found if samples else found.drop("ci_low", "ci_high")


def due_groups(agg: DataFrame) -> DataFrame:
    """Groups whose expensive statistics are due: never done, or grown by 10 or by a fifth, whichever is less."""
    last = F.col("last_expensive_n")
    return agg.where((F.col("n") >= 10) & (last.isNull() | (F.col("n") >= F.least(last + 10, F.ceil(last * 1.2)))))


#: What a refresh finds for a group; groups that were not due keep what they had, or have nulls.
REFRESHED = {
    "median_return": "double", "ci_low": "double", "ci_high": "double", "sign_pvalue": "double", "shrunk_mean": "double", "train_n": "long", "test_n": "long", "train_mean": "double", "test_mean_return": "double",
    "holdout_accuracy": "double", "last_expensive_n": "long",
}


SCOPE = ["entity_id", "intent_label", "asset_key", "horizon_seconds"]


def _measured(own: DataFrame, samples: int) -> DataFrame:
    """pattern_key, hold-out, median and, with samples, interval of groups that fit a task; rows that are dealt by some of the keys stay where they are, and only the values of a group are held together."""
    keys = _keys(own)
    group = Window.partitionBy(*keys)
    placed = own.withColumns({"_i": F.row_number().over(group.orderBy("episode_ts", "observation_key")), "_n": F.count("*").over(group)})
    held = placed.groupBy(*keys).agg(*in_halves("return_value"), F.sort_array(F.collect_list("return_value")).alias("_values"))
    at = lambda place: F.element_at("_values", place.cast("int"))
    size = F.size("_values")
    middle = (at(F.floor((size + 1) / 2)) + at(F.ceil((size + 1) / 2))) / 2
    held = held.select("pattern_key", "train_n", "test_n", "train_mean", "test_mean_return", accuracy(), middle.alias("median_return"), "_values")
    if not samples:
        return held.drop("_values")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            starts, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            low, high = np.empty(len(sizes)), np.empty(len(sizes))
            for size in np.unique(sizes):
                alike = np.flatnonzero(sizes == size)
                for part in np.array_split(alike, max(1, len(alike) * int(size) // 500_000)):
                    low[part], high[part] = intervals(flat[starts[part][:, None] + np.arange(size)], samples, SEED)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(low), pa.array(high)], names=[*batch.schema.names[:-1], "ci_low", "ci_high"])

    kept = held.drop("_values")
    return held.mapInArrow(measure, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", ci_low double, ci_high double")


def refresh_stats(agg: DataFrame, obs: DataFrame, strength: float = 20.0, samples: int = 1000, at_most: int | None = None, prior: DataFrame | None = None) -> DataFrame:
    """The state `agg` after its due groups were measured: KEY, SUMS, the columns of REFRESHED, qvalue and maturity.

    q-values run over the whole family, in which groups never tested count as p = 1, and maturity is told anew for every group. last_expensive_n is what due_groups() asks for next time. Without samples intervals stay as they were.
    at_most is a bound on the rows of a group, if one is known; prior, if at hand, has the mean return of each SCOPE's episodes as _prior. Rows of groups that are not due are left out before they are sorted if the due ones are few.
    """
    agg = materialize(agg, "state")
    due = materialize(due_groups(agg).select(*KEY, *SUMS), "due-groups")
    few = due.count() <= BROADCAST_ROWS
    own = obs.select(*_keys(obs), "episode_ts", "observation_key", "return_value")
    own = own.join(F.broadcast(due.select("pattern_key")), "pattern_key", "left_semi") if few else own
    most = at_most if at_most is not None else own.groupBy("pattern_key").count().agg(F.max("count")).first()[0] or 0
    if most <= HELD:
        found = _measured(own, samples)
    else:
        rows = materialize(own.join(due.select("pattern_key"), "pattern_key", "left_semi").select("pattern_key", "episode_ts", "observation_key", "return_value"), "due-observations")
        found = holdout(rows, ["pattern_key"], "return_value", ["episode_ts", "observation_key"]).join(summary(rows, ["pattern_key"], "return_value").select("pattern_key", "median_return"), "pattern_key")
        found = found.join(bootstrap_ci(rows, ["pattern_key"], "return_value", samples, SEED), "pattern_key", "left") if samples else found
    if prior is None:
        prior = obs.select(*SCOPE, "episode_id", "return_value").distinct().groupBy(*SCOPE).agg(F.avg("return_value").alias("_prior"))
    tested = due.withColumn("sign_pvalue", sign_test(F.col("negative_count"), F.col("positive_count")))
    tested = (F.broadcast(tested) if few else tested).join(found, "pattern_key").join(small(materialize(prior, "priors")), SCOPE, "left").withColumn("shrunk_mean", shrink(F.col("n"), F.col("sum_return") / F.col("n"), F.coalesce("_prior", F.lit(0.0)), strength)).withColumn("last_expensive_n", F.col("n"))
    new = [c for c in REFRESHED if c in tested.columns]
    tested = tested.select("pattern_key", *[F.col(c).alias(f"_new_{c}") for c in new])
    both = agg.join(F.broadcast(tested) if few else tested, "pattern_key", "left")
    held = {c: F.col(c).cast(t) if c in agg.columns else F.lit(None).cast(t) for c, t in REFRESHED.items()}
    # What was measured now replaces all of a group's former values, nulls included.
    fresh = F.col("_new_last_expensive_n").isNotNull()
    family = both.select(*KEY, *SUMS, *[(F.when(fresh, F.col(f"_new_{c}")).otherwise(old) if c in new else old).alias(c) for c, old in held.items()])
    rated = bh_qvalues(family, [], "sign_pvalue")
    discard(agg, due)
    first = train_mean(F.col("sum_return") / F.col("n"), F.col("n"), F.col("test_mean_return"), F.coalesce("test_n", F.lit(0)), F.col("train_n"))
    level = maturity(F.col("n"), F.col("ci_low"), F.col("ci_high"), F.col("qvalue"), F.col("holdout_accuracy"), first, F.col("test_mean_return"))
    return rated.withColumn("maturity", level)


def maturity(n: Column, ci_low: Column, ci_high: Column, qvalue: Column, accuracy: Column, train_mean: Column, test_mean: Column) -> Column:
    """EARLY, PROMISING, ESTABLISHING or ROBUST, by sample size, interval, q-value and hold-out."""
    clear = F.coalesce((ci_low > 0) | (ci_high < 0), F.lit(False)) & ci_low.isNotNull() & ci_high.isNotNull()
    same = F.coalesce(train_mean * test_mean > 0, F.lit(False))
    right = F.coalesce(accuracy, F.lit(0.0))
    robust = (n >= 100) & clear & F.coalesce(qvalue <= 0.05, F.lit(False)) & same & (right >= 0.60)
    return F.when(n < 20, "EARLY").when(robust, "ROBUST").when((n >= 50) & clear & same & (right >= 0.55), "ESTABLISHING").otherwise("PROMISING")


def train_mean(mean: Column, n: Column, test_mean: Column, test_n: Column, train_n: Column) -> Column:
    """The mean of the training part, from the whole and the test part."""
    return F.try_divide(mean * n - F.coalesce(test_mean, F.lit(0.0)) * test_n, train_n)


def change_feed(previous: DataFrame, current: DataFrame, marks: tuple[int, ...] = MILESTONES) -> DataFrame:
    """pattern_key, kind, detail for groups that grew by 5 or more, passed a milestone or changed maturity."""
    old = previous.select("pattern_key", F.col("n").alias("_n"), F.col("maturity").alias("_m"))
    both = current.select("pattern_key", "n", "maturity").join(old, "pattern_key", "left").fillna(0, ["_n"])
    passed = F.array_max(F.filter(F.array(*map(F.lit, marks)), lambda m: (m > F.col("_n")) & (m <= F.col("n"))))
    event = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))
    events = F.array_compact(F.array(event(F.col("n") - F.col("_n") >= 5, "sample", F.col("n")), event(passed.isNotNull(), "milestone", passed), event(F.col("_m").isNotNull() & (F.col("_m") != F.col("maturity")), "maturity", F.col("maturity"))))
    return both.select("pattern_key", F.explode(events).alias("e")).select("pattern_key", "e.kind", "e.detail")


def fingerprint(*layers: DataFrame) -> DataFrame:
    """One row: a hash of the layers' observation counts."""
    counts = layers[0].agg(F.count("*").alias("_c0"))
    for k, layer in enumerate(layers[1:], 1):
        counts = counts.join(layer.agg(F.count("*").alias(f"_c{k}")))
    return counts.select(F.sha2(F.concat_ws("|", *[f"_c{k}" for k in range(len(layers))]), 256).alias("fingerprint"))


def enrich_candidates(ev: DataFrame, enrich: DataFrame, min_usd: float, limit: int) -> DataFrame:
    """The largest transactions without enrichment: tx_hash, chain, usd_value."""
    large = ev.where(F.col("tx_hash").isNotNull() & (F.col("usd_value") >= min_usd)).groupBy("tx_hash", "chain").agg(F.max("usd_value").alias("usd_value"))
    return large.join(enrich.select("tx_hash", "chain").distinct(), ["tx_hash", "chain"], "left_anti").orderBy(F.desc("usd_value"), "tx_hash", "chain").limit(limit)


def invalidate_events(ev: DataFrame, changed: DataFrame, on: list[str]) -> DataFrame:
    """event_id of events that a change (by transaction, wallet, ...) marks as unbuilt."""
    return ev.join(changed.select(*on).distinct(), on, "left_semi").select("event_id").distinct()
