"""Registered queries on prices, returns and regimes, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import market as M
from tracewright.sources import fixtures as X
from tracewright.sources.fixtures import BTC, ETH, EV, HORIZONS, NOW, PX

BENCH = {"btc": BTC, "eth": ETH}


def episodes(spark, d):
    """Events as one-event episodes on the hourly grid; some without an asset."""
    hour = (F.floor(F.col("ts") / 3600) * 3600).cast("long")
    asset = F.when(F.col("k") % 29 != 0, F.col("primary_asset_key"))
    return X.events(spark, d).select(F.col("event_id").alias("episode_id"), "entity_id", "wallet", hour.alias("start_ts"), asset.alias("asset_key"), "k")


EPS = f"{EV}, {PX}, ep AS (SELECT event_id AS episode_id, entity_id, wallet, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS start_ts, CASE WHEN k % 29 <> 0 THEN primary_asset_key END AS asset_key, k FROM ev)"
_H = f"(SELECT unnest({list(HORIZONS)}) AS horizon_seconds)"
LABELS = f"""{EPS}, lab AS (SELECT e.episode_id, e.asset_key, e.start_ts, h.horizon_seconds, a.price AS price_start, b.price AS price_end, b.price / nullif(a.price, 0) - 1 AS simple_return,
  b1.price / nullif(b0.price, 0) - 1 AS btc_return, e1.price / nullif(e0.price, 0) - 1 AS eth_return FROM ep e CROSS JOIN {_H} h
  LEFT JOIN px a ON a.asset_key = e.asset_key AND a.ts = e.start_ts LEFT JOIN px b ON b.asset_key = e.asset_key AND b.ts = e.start_ts + h.horizon_seconds
  LEFT JOIN px b0 ON b0.asset_key = '{BTC}' AND b0.ts = e.start_ts LEFT JOIN px b1 ON b1.asset_key = '{BTC}' AND b1.ts = e.start_ts + h.horizon_seconds
  LEFT JOIN px e0 ON e0.asset_key = '{ETH}' AND e0.ts = e.start_ts LEFT JOIN px e1 ON e1.asset_key = '{ETH}' AND e1.ts = e.start_ts + h.horizon_seconds)"""


def _context_sql(name: str, asset: str) -> str:
    p = [f"{name}{k}" for k in range(5)]
    joins = " ".join(f"LEFT JOIN px {p[k]} ON {p[k]}.asset_key = '{asset}' AND {p[k]}.ts = s.start_ts - {M.STEP * (4 - k)}" for k in range(5))
    logs = [f"ln({b}.price / {a}.price)" for a, b in zip(p, p[1:], strict=False)]
    valid = " AND ".join(f"{x}.price > 0" for x in p)
    return f"SELECT s.start_ts, {p[4]}.price / nullif({p[0]}.price, 0) - 1 AS r, CASE WHEN {valid} THEN (SELECT stddev_pop(v) FROM (SELECT unnest([{', '.join(logs)}]) AS v)) END AS vol FROM (SELECT DISTINCT start_ts FROM ep) s {joins}"


CONTEXT = f"""{EPS}, cb AS ({_context_sql("b", BTC)}), ce AS ({_context_sql("e", ETH)}),
  ctx AS (SELECT episode_id, cb.r AS btc_return_24h, ce.r AS eth_return_24h, cb.vol AS btc_vol, ce.vol AS eth_vol, CASE WHEN cb.r IS NULL THEN 'unknown' WHEN cb.r >= 0.02 THEN 'risk_on' WHEN cb.r <= -0.02 THEN 'risk_off' ELSE 'neutral' END AS regime
  FROM ep JOIN cb USING (start_ts) JOIN ce USING (start_ts))"""
_REQUIRED = f"""{EPS}, asd AS (SELECT DISTINCT start_ts, unnest([asset_key, '{BTC}', '{ETH}']) AS asset_key FROM ep), req AS (SELECT asset_key, start_ts AS ts FROM asd WHERE asset_key IS NOT NULL
  UNION SELECT asset_key, start_ts + horizon_seconds FROM asd CROSS JOIN {_H} WHERE asset_key IS NOT NULL AND start_ts + horizon_seconds <= {NOW}
  UNION SELECT a, start_ts - {M.STEP} * i FROM ep, (SELECT unnest(['{BTC}', '{ETH}']) AS a), (SELECT unnest([0, 1, 2, 3, 4]) AS i))"""


def labels(spark, d):
    return M.forward_returns(episodes(spark, d), X.prices(spark, d), HORIZONS, BENCH)


def m1_horizons(spark, d):
    return M.expand_horizons(episodes(spark, d), HORIZONS).select("episode_id", "horizon_seconds", (F.col("start_ts") + F.col("horizon_seconds")).alias("end_ts"))


def m2_required_points(spark, d):
    return M.required_points(episodes(spark, d), HORIZONS, (BTC, ETH), NOW)


def m3_missing_points(spark, d):
    return M.missing_points(M.required_points(episodes(spark, d), HORIZONS, (BTC, ETH), NOW), X.prices(spark, d), NOW)


def m3_point_metrics(spark, d):
    return M.price_metrics(M.required_points(episodes(spark, d), HORIZONS, (BTC, ETH), NOW), X.prices(spark, d))


def m4_flatten_prices(spark, d):
    px = X.prices(spark, d).withColumn("p", (F.floor(F.col("price") * 1000) / 1000).cast("string"))
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('{"'), F.element_at(F.array(F.lit("timestamp"), F.lit("time"), F.lit("t")), (F.col("ts") / 3600 % 3 + 1).cast("int")), F.lit('": '), "ts", F.lit(', "price": '), "p", F.lit("}")))), ","), F.lit("]"))
    mapped = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "ts", F.lit('": '), "p"))), ","), F.lit("}"))
    day = F.floor(F.col("ts") / 86400).alias("day")
    raw = px.groupBy("asset_key", day).agg(listed.alias("a"), mapped.alias("b")).select("asset_key", F.when(F.col("day") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("payload"))
    return M.flatten_prices(raw).select("asset_key", "ts", "price")


def m5_upsert_prices(spark, d):
    px = X.prices(spark, d).withColumn("fetched_at", F.lit(NOW).cast("long"))
    new = px.where("ts % 10800 = 0").withColumn("status", F.when(F.col("ts") % 21600 == 0, "unavailable").otherwise("retryable")).withColumn("price", F.lit(None).cast("double")).withColumn("fetched_at", F.lit(NOW + 60).cast("long"))
    return M.upsert_prices(px, new).groupBy("asset_key", "status", "expires_at").agg(F.count("*").alias("n"), F.count("price").alias("n_priced"))


def m6_forward_returns(spark, d):
    return labels(spark, d).select("episode_id", "asset_key", "horizon_seconds", *[F.round(c, 6).alias(c) for c in ("price_start", "price_end", "simple_return", "btc_return", "eth_return", "excess_vs_btc", "excess_vs_eth")])


def m7_horizon_states(spark, d):
    first = M.horizon_states(labels(spark, d), NOW)
    old = first.select("episode_id", "horizon_seconds", F.when(F.col("state") == "retryable failure", F.when(F.col("episode_id").cast("long") % 2 == 0, 2).otherwise(1)).otherwise(0).alias("attempts"))
    return M.horizon_states(labels(spark, d), NOW, old).groupBy("horizon_seconds", "state", "attempts").agg(F.count("*").alias("n"), F.min("next_retry").alias("least_retry"))


def m8_pre_event_context(spark, d):
    return M.pre_event_context(episodes(spark, d), X.prices(spark, d), BENCH).select("episode_id", F.round("btc_return_24h", 6).alias("btc_return_24h"), F.round("eth_return_24h", 6).alias("eth_return_24h"))


def m9_volatility(spark, d):
    return M.pre_event_context(episodes(spark, d), X.prices(spark, d), BENCH).select("episode_id", F.round("btc_vol", 6).alias("btc_vol"), F.round("eth_vol", 6).alias("eth_vol"))


def m10_regime(spark, d):
    return M.pre_event_context(episodes(spark, d), X.prices(spark, d), BENCH).select("episode_id", "regime")


def m11_labelable(spark, d):
    ep = episodes(spark, d).withColumnRenamed("asset_key", "primary_asset_key").withColumn("target_asset_key", F.when(F.col("k") % 31 == 0, "asset:target"))
    return M.labelable(ep, 2000).select("episode_id", "asset_key", "start_ts")


def m12_due(spark, d):
    ep = episodes(spark, d)
    return M.due(ep, M.horizon_states(labels(spark, d), NOW), NOW + 3600).select("entity_id", "episode_id")


def m13_backfill_states(spark, d):
    return M.backfill_states(episodes(spark, d), labels(spark, d), HORIZONS).groupBy("horizon_seconds", "state").agg(F.count("*").alias("n"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "m" and name[1:2].isdigit()}

_STATE = f"""{LABELS}, st AS (SELECT *, CASE WHEN asset_key IS NULL THEN 'permanently unavailable' WHEN start_ts + horizon_seconds > {NOW} THEN 'pending' WHEN simple_return IS NOT NULL THEN 'success' ELSE 'failed' END AS s0 FROM lab)"""
_ROUNDED = ", ".join(f"round({e}, 6) AS {c}" for c, e in (("price_start", "price_start"), ("price_end", "price_end"), ("simple_return", "simple_return"), ("btc_return", "btc_return"), ("eth_return", "eth_return"), ("excess_vs_btc", "simple_return - btc_return"), ("excess_vs_eth", "simple_return - eth_return")))
ORACLES = {
    "m1_horizons": f"WITH {EPS} SELECT episode_id, CAST(horizon_seconds AS INT) AS horizon_seconds, start_ts + horizon_seconds AS end_ts FROM ep CROSS JOIN {_H}",
    "m2_required_points": f"WITH {_REQUIRED} SELECT asset_key, ts FROM req",
    "m3_missing_points": f"WITH {_REQUIRED} SELECT asset_key, ts FROM req WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.asset_key = req.asset_key AND px.ts = req.ts)",
    "m3_point_metrics": f"WITH {_REQUIRED} SELECT req.asset_key, count(px.ts) AS hits, count(*) - count(px.ts) AS misses FROM req LEFT JOIN px ON px.asset_key = req.asset_key AND px.ts = req.ts GROUP BY 1",
    "m4_flatten_prices": f"WITH {PX} SELECT asset_key, ts, floor(price * 1000) / 1000 AS price FROM px",
    "m5_upsert_prices": f"""WITH {PX}, a AS (SELECT asset_key, CASE WHEN ts % 21600 = 0 THEN 'unavailable' WHEN ts % 10800 = 0 THEN 'retryable' ELSE 'success' END AS status FROM px)
      SELECT asset_key, status, CASE status WHEN 'unavailable' THEN {NOW + 60 + M.UNAVAILABLE_S} WHEN 'retryable' THEN {NOW + 60 + M.RETRY_S} END AS expires_at, count(*) AS n, count(*) FILTER (status = 'success') AS n_priced FROM a GROUP BY 1, 2""",
    "m6_forward_returns": f"WITH {LABELS} SELECT episode_id, asset_key, horizon_seconds, {_ROUNDED} FROM lab",
    "m7_horizon_states": f"""WITH {_STATE}, t AS (SELECT horizon_seconds, start_ts, s0, CASE WHEN s0 <> 'failed' THEN 0 WHEN CAST(episode_id AS BIGINT) % 2 = 0 THEN 3 ELSE 2 END AS attempts FROM st),
      u AS (SELECT *, CASE WHEN s0 = 'failed' THEN CASE WHEN attempts >= 3 THEN 'permanently unavailable' ELSE 'retryable failure' END ELSE s0 END AS state FROM t)
      SELECT horizon_seconds, state, CAST(attempts AS INT) AS attempts, count(*) AS n, min(CASE state WHEN 'retryable failure' THEN {NOW + M.RETRY_S} WHEN 'pending' THEN start_ts + horizon_seconds END) AS least_retry FROM u GROUP BY 1, 2, 3""",
    "m8_pre_event_context": f"WITH {CONTEXT} SELECT episode_id, round(btc_return_24h, 6) AS btc_return_24h, round(eth_return_24h, 6) AS eth_return_24h FROM ctx",
    "m9_volatility": f"WITH {CONTEXT} SELECT episode_id, round(btc_vol, 6) AS btc_vol, round(eth_vol, 6) AS eth_vol FROM ctx",
    "m10_regime": f"WITH {CONTEXT} SELECT episode_id, regime FROM ctx",
    "m11_labelable": f"WITH {EPS} SELECT episode_id, CASE WHEN k % 31 = 0 THEN 'asset:target' ELSE asset_key END AS asset_key, start_ts FROM ep WHERE k % 31 = 0 OR asset_key IS NOT NULL ORDER BY start_ts, episode_id LIMIT 2000",
    "m12_due": f"""WITH {_STATE} SELECT entity_id, episode_id FROM ep WHERE episode_id IN (SELECT episode_id FROM st WHERE (s0 = 'failed' AND {NOW + M.RETRY_S} <= {NOW + 3600}) OR (s0 = 'pending' AND start_ts + horizon_seconds <= {NOW + 3600}))""",
    "m13_backfill_states": f"WITH {LABELS} SELECT horizon_seconds, CASE WHEN simple_return IS NULL THEN 'pending' ELSE 'success' END AS state, count(*) AS n FROM lab GROUP BY 1, 2",
}
