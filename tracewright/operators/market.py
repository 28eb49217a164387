"""Prices, forward returns and pre-event regimes, joined on exact times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.shared import materialize, small

#: Attempts after which a horizon without a price is given up; seconds until a retry, and for which an unavailable price is remembered.
ATTEMPTS, RETRY_S, UNAVAILABLE_S = 3, 60, 21600
STEP = 21600


def expand_horizons(ep: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    return ep.withColumn("horizon_seconds", F.explode(F.array(*map(F.lit, horizons))))


def required_points(ep: DataFrame, horizons: tuple[int, ...], benchmarks: tuple[str, ...], now: int) -> DataFrame:
    """Distinct (asset_key, ts) that labels and context of these episodes need: starts, matured ends, and the benchmarks' five points before."""
    assets = F.array_distinct(F.array_compact(F.array(F.col("asset_key"), *map(F.lit, benchmarks))))
    each = ep.select("start_ts", F.explode(assets).alias("asset_key"))
    times = F.filter(F.array(F.lit(0), *map(F.lit, horizons)), lambda h: (h == 0) | (F.col("start_ts") + h <= now))
    forward = each.select("asset_key", F.explode(F.transform(times, lambda h: F.col("start_ts") + h)).alias("ts"))
    back = ep.select("start_ts", F.explode(F.array(*map(F.lit, benchmarks))).alias("asset_key"))
    back = back.select("asset_key", F.explode(F.array(*[F.col("start_ts") - STEP * k for k in range(5)])).alias("ts"))
    return forward.unionByName(back).distinct()


def missing_points(required: DataFrame, px: DataFrame, now: int) -> DataFrame:
    """Required points that are neither priced nor remembered as unavailable."""
    known = px.where((F.col("status") == "success") | (F.col("expires_at") > now) if "expires_at" in px.columns else F.col("status") == "success")
    return required.join(known.select("asset_key", "ts"), ["asset_key", "ts"], "left_anti")


def flatten_prices(raw: DataFrame) -> DataFrame:
    """asset_key, ts, price from payloads of either shape: a list of points under one of three time names, or a map from time to price. Only finite prices stay."""
    points = F.from_json("payload", "array<struct<timestamp double, time double, t double, price double>>")
    mapped = F.from_json("payload", "map<string,double>")
    is_list = F.ltrim(F.col("payload")).startswith("[")
    listed = raw.where(is_list).select("asset_key", F.explode(points).alias("p")).select("asset_key", F.coalesce("p.timestamp", "p.time", "p.t").cast("long").alias("ts"), F.col("p.price").alias("price"))
    keyed = raw.where(~is_list).select("asset_key", F.explode(mapped).alias("_k", "price")).select("asset_key", F.col("_k").try_cast("double").try_cast("long").alias("ts"), "price")
    return listed.unionByName(keyed).where("ts is not null and price is not null and not isnan(price) and abs(price) < double('infinity')")


def upsert_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row (fetched_at) per asset, time, resolution and source; unavailable and failed rows expire."""
    expires = F.when(F.col("status") == "unavailable", F.col("fetched_at") + UNAVAILABLE_S).when(F.col("status") == "retryable", F.col("fetched_at") + RETRY_S)
    latest = Window.partitionBy("asset_key", "ts", "resolution", "source").orderBy(F.desc("fetched_at"), F.desc("status"))
    return old.unionByName(new).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r").withColumn("expires_at", expires)


def simple_return(start: Column, end: Column) -> Column:
    return F.try_divide(end, F.nullif(start, F.lit(0.0))) - 1


def _points(px: DataFrame) -> DataFrame:
    """asset_key, ts, price: one price for each time, stored; few enough of them are broadcast, so that the many rows they are looked up for are not dealt out anew for every point."""
    return small(materialize(px.where("status = 'success'").groupBy("asset_key", "ts").agg(F.min_by("price", "source").alias("price")), "price-points"))


def _priced(df: DataFrame, points: DataFrame, asset: Column, at: Column, out: str) -> DataFrame:
    """Adds the price of an asset at exactly one time."""
    named = points.select(F.col("asset_key").alias("_asset"), F.col("ts").alias("_at"), F.col("price").alias(out))
    return df.withColumn("_asset", asset).withColumn("_at", at).join(named, ["_asset", "_at"], "left").drop("_asset", "_at")


def forward_returns(ep: DataFrame, px: DataFrame, horizons: tuple[int, ...], benchmarks: dict[str, str]) -> DataFrame:
    """Labels: episode_id, asset_key, horizon_seconds, price_start, price_end, simple_return, <name>_return and excess_vs_<name> for each benchmark.

    Prices count only at the exact times; a missing or zero start gives no return, a missing benchmark no excess.
    """
    out = expand_horizons(ep.select("episode_id", "asset_key", "start_ts"), horizons)
    end, points = F.col("start_ts") + F.col("horizon_seconds"), _points(px)
    out = _priced(_priced(out, points, F.col("asset_key"), F.col("start_ts"), "price_start"), points, F.col("asset_key"), end, "price_end")
    out = out.withColumn("simple_return", simple_return(F.col("price_start"), F.col("price_end")))
    for name, asset in benchmarks.items():
        out = _priced(_priced(out, points, F.lit(asset), F.col("start_ts"), "_p0"), points, F.lit(asset), end, "_p1")
        out = out.withColumn(f"{name}_return", simple_return(F.col("_p0"), F.col("_p1"))).drop("_p0", "_p1").withColumn(f"excess_vs_{name}", F.col("simple_return") - F.col(f"{name}_return"))
    return out


def horizon_states(labels: DataFrame, now: int, old: DataFrame | None = None) -> DataFrame:
    """episode_id, horizon_seconds, state, attempts, next_retry: pending until matured, success with a return, else retryable until ATTEMPTS are used up; no asset: permanently unavailable."""
    out = labels.select("episode_id", "asset_key", "start_ts", "horizon_seconds", "simple_return")
    out = out.withColumn("_before", F.lit(0)) if old is None else out.join(old.select("episode_id", "horizon_seconds", F.col("attempts").alias("_before")), ["episode_id", "horizon_seconds"], "left").fillna(0, ["_before"])
    matured = F.col("start_ts") + F.col("horizon_seconds") <= now
    failed = matured & F.col("asset_key").isNotNull() & F.col("simple_return").isNull()
    attempts = F.col("_before") + F.when(failed, 1).otherwise(0)
    state = F.when(F.col("asset_key").isNull(), "permanently unavailable").when(~matured, "pending").when(F.col("simple_return").isNotNull(), "success").when(attempts >= ATTEMPTS, "permanently unavailable").otherwise("retryable failure")
    return out.select("episode_id", "horizon_seconds", state.alias("state"), attempts.cast("int").alias("attempts"), F.when(state == "retryable failure", F.lit(now) + RETRY_S).when(state == "pending", F.col("start_ts") + F.col("horizon_seconds")).alias("next_retry"))


def regime(day_return: Column) -> Column:
    return F.when(day_return.isNull(), "unknown").when(day_return >= 0.02, "risk_on").when(day_return <= -0.02, "risk_off").otherwise("neutral")


def pre_event_context(ep: DataFrame, px: DataFrame, benchmarks: dict[str, str]) -> DataFrame:
    """episode_id, <name>_return_24h and <name>_vol for each benchmark, regime: returns and population volatility of log steps over the 24 hours before the start, from five exact points; null where one is missing or not positive."""
    out, prices = ep.select("episode_id", "start_ts"), _points(px)
    for name, asset in benchmarks.items():
        points = [f"_p{k}" for k in range(5)]
        for k, point in enumerate(points):
            out = _priced(out, prices, F.lit(asset), F.col("start_ts") - STEP * (4 - k), point)
        steps = [F.ln(F.try_divide(F.col(b), F.col(a))) for a, b in zip(points, points[1:], strict=False)]
        mean = sum(steps, F.lit(0.0)) / 4
        valid = F.lit(True)
        for point in points:
            valid &= F.coalesce(F.col(point) > 0, F.lit(False))
        vol = F.when(valid, F.sqrt(sum(((s - mean) * (s - mean) for s in steps), F.lit(0.0)) / 4))
        out = out.withColumn(f"{name}_return_24h", simple_return(F.col("_p0"), F.col("_p4"))).withColumn(f"{name}_vol", vol).drop(*points)
    return out.withColumn("regime", regime(F.col(f"{next(iter(benchmarks))}_return_24h")))


def labelable(ep: DataFrame, limit: int | None = None) -> DataFrame:
    """Episodes that have an asset to label, by start, with it in asset_key."""
    out = ep.withColumn("asset_key", F.coalesce("target_asset_key", "primary_asset_key")).where("asset_key is not null")
    return out if limit is None else out.orderBy("start_ts", "episode_id").limit(limit)


def due(ep: DataFrame, states: DataFrame, now: int) -> DataFrame:
    """Episodes with a horizon that is pending or retryable and due."""
    open_ = states.where(F.col("state").isin("pending", "retryable failure") & (F.col("next_retry") <= now))
    return ep.join(open_.select("episode_id").distinct(), "episode_id", "left_semi")


def backfill_states(ep: DataFrame, labels: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """State of each episode and horizon from labels alone: success where any return exists, else pending."""
    found = labels.where("simple_return is not null").select("episode_id", "horizon_seconds", F.lit("success").alias("state")).distinct()
    return expand_horizons(ep.select("episode_id"), horizons).join(found, ["episode_id", "horizon_seconds"], "left").select("episode_id", "horizon_seconds", F.coalesce("state", F.lit("pending")).alias("state"))


def price_metrics(required: DataFrame, px: DataFrame) -> DataFrame:
    """asset_key, hits, misses of the required points."""
    known = px.where("status = 'success'").select("asset_key", "ts", F.lit(1).alias("_hit")).distinct()
    return required.join(known, ["asset_key", "ts"], "left").groupBy("asset_key").agg(F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
