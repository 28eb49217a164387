"""Group statistics: summaries, sign tests, false discovery rates, hold-outs, shrinkage, bootstrap intervals. No group is gathered in one task (see `ordered`)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import ordered
from tracewright.sources.shared import BROADCAST_ROWS, materialize


def summary(df: DataFrame, keys: list[str], value: str, part: int = ordered.PART, at_most: int | None = None) -> DataFrame:
    """n, mean_return, median_return, std_return (0 for one row), negative_count, positive_count; zeros are in neither count. Values are not null.

    Rows are numbered in order of their value, and the median is the mean of the one or two in the middle; all else is counted in the same pass. at_most: as in ordered.segmented().
    """
    v = F.col(value)
    rows, ids = ordered.with_id(df.select(*keys, value), keys)
    found = ordered.positions(rows, ids, [value], part, at_most).groupBy(*dict.fromkeys([*ids, *keys])).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean_return"), F.avg(F.when(ordered.is_middle(), v)).alias("median_return"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_return"),
        F.count_if(v < 0).alias("negative_count"), F.count_if(v > 0).alias("positive_count"),
    )
    return found.select(*keys, "n", "mean_return", "median_return", "std_return", "negative_count", "positive_count")


def sign_test(negative: Column, positive: Column) -> Column:
    """Two-sided p-value of min(neg, pos) or fewer among neg + pos fair signs; 1 where there are none. The tail is folded in log space, term by term from the last."""
    n, k = (negative + positive).cast("long"), F.least(negative, positive).cast("long")
    state = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum"))
    # Terms C(n, i) relative to the largest, C(n, k), from i = k down.
    folded = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), state, lambda s, j: F.struct((s["log"] + F.ln((k - j + 1).cast("double")) - F.ln((n - k + j).cast("double"))).alias("log"), (s["sum"] + F.exp(s["log"] + F.ln((k - j + 1).cast("double")) - F.ln((n - k + j).cast("double")))).alias("sum")))
    peak = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, j: s + F.ln((n - k + j).cast("double")) - F.ln(j.cast("double")))
    total = F.when(k == 0, F.lit(1.0)).otherwise(folded["sum"] * 1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total * F.exp(F.when(k == 0, 0.0).otherwise(peak) - n * F.ln(F.lit(2.0)))))


def bh_qvalues(df: DataFrame, family: list[str], p: str, out: str = "qvalue") -> DataFrame:
    """Benjamini-Hochberg within each family (no columns: all rows are one): a running minimum from the largest p of p * m / rank; tied p share a q, a null p counts as 1.

    Ranks and minima run over the distinct p-values, in ranges of them: each range by itself, then over one total per range.
    """
    filled = materialize(df.withColumn("_p", F.coalesce(p, F.lit(1.0))), "rated")
    counts = materialize(filled.groupBy(*family, "_p").agg(F.count("*").alias("_count")), "p-values")
    few = counts.count() <= BROADCAST_ROWS
    ranked = ordered.running(counts, family, "_p", "_count", "_rank")
    if family:
        ranked = ranked.join(counts.groupBy(*family).agg(F.sum("_count").alias("_m")), family)
    else:
        ranked = ranked.withColumn("_m", F.lit(counts.agg(F.sum("_count")).first()[0]))
    each = ranked.withColumn("_raw", F.least(F.lit(1.0), F.col("_p") * F.col("_m") / F.col("_rank")))
    q = ordered.least_from_here(each, family, "_p", "_raw", out)
    q = q.select(*family, "_p", out)
    return filled.join(F.broadcast(q) if few else q, [*family, "_p"]).drop("_p")


def holdout(df: DataFrame, keys: list[str], value: str, order: list[str], share: float = 0.7, part: int = ordered.PART, at_most: int | None = None) -> DataFrame:
    """train_n, test_n, train_mean, test_mean_return, holdout_accuracy: the first share of a group's rows in order (at least one) sets the direction, and the rest is scored on it."""
    rows, ids = ordered.with_id(df.select(*dict.fromkeys([*keys, value, *order])), keys)
    placed = ordered.positions(rows, ids, order, part, at_most)
    halves = placed.groupBy(*dict.fromkeys([*ids, *keys])).agg(*in_halves(value, share))
    return halves.select(*keys, "train_n", "test_n", "train_mean", "test_mean_return", accuracy())


def in_halves(value: str, share: float = 0.7) -> list[Column]:
    """What holdout() counts of a group's numbered rows (_i of _n)."""
    train = F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share + 1e-9))
    means = [F.avg(F.when(train, F.col(value))).alias("train_mean"), F.avg(F.when(~train, F.col(value))).alias("test_mean_return")]
    return [F.count_if(train).alias("train_n"), F.count_if(~train).alias("test_n"), *means, F.count_if(~train & (F.col(value) < 0)).alias("_neg"), F.count_if(~train & (F.col(value) > 0)).alias("_pos")]


def accuracy() -> Column:
    """holdout_accuracy of what in_halves() counted."""
    right = F.when(F.col("train_mean") < 0, F.col("_neg")).otherwise(F.col("_pos"))
    return F.when(F.col("test_n") > 0, right / F.col("test_n")).alias("holdout_accuracy")


def shrink(n: Column, mean: Column, prior: Column, strength: float = 20.0) -> Column:
    """The mean drawn toward a prior that weighs as many observations as `strength`."""
    return (n * mean + strength * prior) / (n + strength)


@lru_cache(maxsize=256)
def drawn_ranks(n: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The middle ranks (from 1) of `samples` resamples of n sorted values: lower, upper (equal for odd n) and how many resamples have both.

    The middle of n uniform draws is beta-distributed, and below it the next one is the greatest of the rest: two random numbers stand for n draws, whatever n is.
    """
    rng, half = np.random.default_rng([seed, n]), n // 2
    upper = rng.beta(half + 1, n - half, samples)
    lower = upper if n % 2 else upper * rng.random(samples) ** (1 / half)
    places = np.minimum(np.floor(np.stack([lower, upper]) * n).astype(np.int64) + 1, n)
    pairs, times = np.unique(places, axis=1, return_counts=True)
    return pairs[0], pairs[1], times


def intervals(rows: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The 2.5 and 97.5 % quantiles of the medians of `samples` resamples of each row, a group's values in ascending order. bootstrap_ci() for groups of one size that fit a task."""
    low, high, times = drawn_ranks(rows.shape[1], samples, seed)
    found = []
    for part in np.array_split(rows, max(1, len(rows) * len(low) // 500_000)):
        medians = (part[:, low - 1] + part[:, high - 1]) / 2
        order = np.argsort(medians, axis=1)
        # Resamples up to and with each median; the quantiles lie between the two resamples around their place.
        upto, medians = np.cumsum(times[order], axis=1), np.take_along_axis(medians, order, axis=1)
        ends = []
        for q in (0.025, 0.975):
            place = q * (samples - 1)
            below, above = (np.take_along_axis(medians, (upto <= k).sum(axis=1)[:, None], axis=1)[:, 0] for k in (int(place), min(int(place) + 1, samples - 1)))
            ends.append(below + (above - below) * (place - int(place)))
        found.append(ends)
    lows, highs = (np.concatenate(x) for x in zip(*found, strict=True))
    return lows, highs


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, samples: int = 2000, seed: int = 42, part: int = ordered.PART, at_most: int | None = None) -> DataFrame:
    """keys, ci_low, ci_high: the 2.5 and 97.5 % quantiles of the medians of `samples` resamples of each group.

    A resampled median is one or two of the group's values, so each resample is drawn as ranks, and the values are looked up by rank. One method for every size: a group sends at most 2 * samples lookups, and
    is never gathered. The draws depend on a group's size and the seed alone. Keys may be null; null values are left out, and groups without values give no row.
    """
    group = F.struct(*keys).alias("_g")
    values = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    ranked = materialize(ordered.positions(values, ["_g"], ["_v"], part, at_most), "ranked-values")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows, numbers, ranks, times, held = [], [], [], [], 0
                while at < batch.num_rows and held < 50_000:
                    low, high, weight = drawn_ranks(batch.column(1)[at].as_py(), samples, seed)
                    number, two = np.arange(len(low)), np.flatnonzero(low != high)
                    ranks.append(np.concatenate([low, high[two]]))
                    numbers.append(np.concatenate([number, two]))
                    times.append(np.concatenate([weight, weight[two]]))
                    rows.append(np.full(len(ranks[-1]), at))
                    held, at = held + len(ranks[-1]), at + 1
                again, numbers, ranks, times = map(np.concatenate, (rows, numbers, ranks, times))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(again)), *map(pa.array, (numbers, ranks, times))], names=["_g", "_draw", "_i", "_times"])

    kind = ranked.schema["_g"].dataType.simpleString()
    wanted = ranked.where("_i = 1").select("_g", "_n").mapInArrow(draw, f"_g {kind}, _draw long, _i long, _times long")
    medians = wanted.join(ranked.select("_g", "_i", "_v"), ["_g", "_i"]).groupBy("_g", "_draw").agg(F.first("_times").alias("_times"), F.avg("_v").alias("_median"))
    # Resamples up to and with this median; the quantiles lie between the two resamples around their place.
    upto = F.sum("_times").over(Window.partitionBy("_g").orderBy("_median", "_draw").rowsBetween(Window.unboundedPreceding, 0))
    placed = medians.withColumn("_upto", upto)

    def quantile(q: float) -> Column:
        place = q * (samples - 1)
        below, above = (F.min(F.when(F.col("_upto") > k, F.col("_median"))) for k in (int(place), min(int(place) + 1, samples - 1)))
        return below + (above - below) * (place - int(place))

    return placed.groupBy("_g").agg(quantile(0.025).alias("ci_low"), quantile(0.975).alias("ci_high")).select("_g.*", "ci_low", "ci_high")
