"""Registered queries on backtest statistics and incremental analysis, each with its DuckDB twin. Episodes here are an account's days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import normalize as N
from tracewright.functions import patterns as P
from tracewright.operators import backtest as B
from tracewright.operators import incremental as I
from tracewright.operators import market as M
from tracewright.operators import stats as S
from tracewright.plans.behaviour import TOKEN, patterns_sql
from tracewright.plans.markets import BENCH
from tracewright.sources import fixtures as X
from tracewright.sources.fixtures import BTC, ETH, EV, HORIZONS, PX
from tracewright.sources.shared import materialize, spread

DAY = 86400
#: Observations take nothing but the regime from the context, and no benchmark's returns.
REGIME = dict(list(BENCH.items())[:1])


def day_episodes(spark, d):
    token = N.action_token(F.col("action_type"), F.col("cex_id"), F.col("project_id"), F.col("cate_id"))
    each = F.struct("ts", "event_id", token.alias("token"), "primary_asset_key", "k")
    grouped = X.events(spark, d).groupBy("entity_id", "wallet", F.floor(F.col("ts") / DAY).alias("day")).agg(F.array_sort(F.collect_list(each)).alias("s"), F.round(F.sum("usd_value"), 6).alias("gross_usd"))
    first = F.element_at("s", 1)
    intent = F.when(first["k"] % 3 == 0, "buy").when(first["k"] % 3 == 1, "sell")
    start = (F.floor(first["ts"] / 3600) * 3600).cast("long")
    tokens = F.col("s.token")
    return grouped.select(F.concat_ws("|", "wallet", "day").alias("episode_id"), "entity_id", F.array("wallet").alias("wallets"), start.alias("start_ts"), P.motif(tokens).alias("motif"), P.patterns(tokens).alias("patterns"), first["primary_asset_key"].alias("asset_key"), intent.alias("intent_label"), "gross_usd")


def day_labels(spark, d):
    return M.forward_returns(day_episodes(spark, d), X.prices(spark, d), HORIZONS, BENCH).withColumn("source", F.lit("events"))


def day_context(spark, d):
    return M.pre_event_context(day_episodes(spark, d), X.prices(spark, d), BENCH)


def _inputs(spark, d):
    """Stored episodes, their labels and contexts, without what observations do not take."""
    ep, px = materialize(spread(day_episodes(spark, d), "episode_id"), "episodes"), X.prices(spark, d)
    return ep, M.forward_returns(ep, px, HORIZONS, {}).withColumn("source", F.lit("events")), M.pre_event_context(ep, px, REGIME)


def observations(spark, d):
    return B.observations(*_inputs(spark, d))


DAYS = f"""{EV}, {PX}, dd AS (SELECT entity_id, wallet, CAST(floor(ts / {DAY}) AS BIGINT) AS day, list({TOKEN} ORDER BY ts, event_id) AS tokens, round(sum(usd_value), 6) AS gross_usd, arg_min(struct_pack(ts := ts, a := primary_asset_key, k := k), (ts, event_id)) AS f FROM ev GROUP BY ALL),
  epd AS (SELECT wallet || '|' || day AS episode_id, entity_id, wallet, CAST(floor(f.ts / 3600) * 3600 AS BIGINT) AS start_ts, array_to_string(tokens, '>') AS motif, {patterns_sql('tokens')} AS patterns, f.a AS asset_key, CASE f.k % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS intent_label, gross_usd FROM dd),
  labd AS (SELECT e.episode_id, e.asset_key, e.start_ts, h.horizon_seconds, b.price / nullif(a.price, 0) - 1 AS simple_return FROM epd e CROSS JOIN (SELECT unnest({list(HORIZONS)}) AS horizon_seconds) h
    JOIN px a ON a.asset_key = e.asset_key AND a.ts = e.start_ts JOIN px b ON b.asset_key = e.asset_key AND b.ts = e.start_ts + h.horizon_seconds),
  rgm AS (SELECT e.episode_id, CASE WHEN b.price IS NULL OR a.price IS NULL THEN 'unknown' WHEN b.price / a.price - 1 >= 0.02 THEN 'risk_on' WHEN b.price / a.price - 1 <= -0.02 THEN 'risk_off' ELSE 'neutral' END AS regime
    FROM epd e LEFT JOIN px a ON a.asset_key = '{BTC}' AND a.ts = e.start_ts - {DAY} LEFT JOIN px b ON b.asset_key = '{BTC}' AND b.ts = e.start_ts),
  obs AS (SELECT e.episode_id, e.entity_id, e.wallet, e.start_ts, e.motif, e.patterns, l.asset_key, l.horizon_seconds, l.simple_return, coalesce(e.intent_label, 'unknown') AS intent_label, e.intent_label AS intent, regime, gross_usd FROM epd e JOIN labd l USING (episode_id) JOIN rgm USING (episode_id)),
  pat AS (SELECT * EXCLUDE (patterns), unnest(list_concat(patterns, CASE WHEN regime <> 'unknown' THEN list_transform(patterns, lambda p: 'REGIME:' || regime || '|' || p) ELSE [] END)) AS pattern FROM obs),
  lvl AS (SELECT episode_id, start_ts, entity_id, asset_key, horizon_seconds, simple_return, level, scope_type, scope_id, pattern, intent_label FROM (
    SELECT *, 'entity_action' AS level, 'entity' AS scope_type, entity_id AS scope_id, split_part(motif, '>', 1) AS pattern, '' AS intent_label FROM obs o(episode_id, entity_id, wallet, start_ts, motif, patterns, asset_key, horizon_seconds, simple_return, il, intent, regime, gross_usd)
    UNION ALL BY NAME SELECT *, 'entity_action_intent' AS level, 'entity' AS scope_type, entity_id AS scope_id, split_part(motif, '>', 1) AS pattern FROM obs
    UNION ALL BY NAME SELECT * EXCLUDE (intent_label), 'entity_pattern' AS level, 'entity' AS scope_type, entity_id AS scope_id, '' AS intent_label FROM pat WHERE NOT starts_with(pattern, 'ACTION:')
    UNION ALL BY NAME SELECT *, 'entity_pattern_intent' AS level, 'entity' AS scope_type, entity_id AS scope_id FROM pat
    UNION ALL BY NAME SELECT *, 'wallet_pattern_intent_asset' AS level, 'wallet' AS scope_type, wallet AS scope_id FROM pat))"""
G = ", ".join(B.GROUP)
#: Groups of at least five observations at the entity's action level, enough for every statistic.
GROUPS = f"{DAYS}, grp AS (SELECT {G}, count(*) AS n, avg(simple_return) AS mean_return, median(simple_return) AS median_return, coalesce(stddev_samp(simple_return), 0) AS std_return, count(*) FILTER (simple_return < 0) AS neg, count(*) FILTER (simple_return > 0) AS pos FROM lvl GROUP BY ALL HAVING count(*) >= 5)"
_TAIL = "CASE WHEN neg + pos = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(neg + pos + 1) - lgamma(i + 1) - lgamma(neg + pos - i + 1) - (neg + pos) * ln(2.0))) FROM (SELECT unnest(range(0, least(neg, pos) + 1)) AS i))) END"
SIGNS = f"{GROUPS}, sgn AS (SELECT *, {_TAIL} AS p FROM grp), rnk AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM sgn), q AS (SELECT *, min(least(1.0, p * m / r)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS q FROM rnk)"


def _millionths(p):
    """A p-value in whole millionths; the offset keeps dyadic fractions off the edge, where engines round either way."""
    return (F.floor(p * 1e6 + 0.3) / 1e6).cast("double")


_MILLIONTHS = "CAST(floor(p * 1e6 + 0.3) / 1e6 AS DOUBLE)"


def _levels(spark, d):
    return B.levels(observations(spark, d))


def _stats(spark, d):
    obs = materialize(spread(observations(spark, d), "episode_id"), "observations")
    return B.decoded(S.summary(B.levels(obs, F.xxhash64), B.CODED, "simple_return", at_most=B.largest_group(obs)).where("n >= 5"), obs)


def q0_flagship(spark, d):
    """For each entity and behaviour pattern: what was the next-day return?"""
    each = B.explode_patterns(observations(spark, d)).where(F.col("horizon_seconds") == DAY)
    stats = S.summary(each, ["entity_id", "pattern"], "simple_return").where("n >= 3").withColumn("p", S.sign_test(F.col("negative_count"), F.col("positive_count")))
    rated = S.bh_qvalues(stats, [], "p")
    return rated.select("entity_id", "pattern", "n", F.round("mean_return", 6).alias("mean_return"), F.round("median_return", 6).alias("median_return"), "negative_count", "positive_count", _millionths(F.col("p")).alias("p"), F.round("qvalue", 6).alias("qvalue"))


def b1_observations(spark, d):
    return observations(spark, d).select("episode_id", "asset_key", "horizon_seconds", F.round("simple_return", 6).alias("simple_return"), "intent_label", "regime")


def b2_one_source(spark, d):
    labels = day_labels(spark, d)
    doubled = labels.unionByName(labels.withColumn("source", F.lit("a_second")).withColumn("simple_return", F.col("simple_return") + 1))
    return B.observations(day_episodes(spark, d), doubled, day_context(spark, d)).select("episode_id", "asset_key", "horizon_seconds", F.round("simple_return", 6).alias("simple_return"))


def b3_regime_patterns(spark, d):
    return B.explode_patterns(observations(spark, d)).groupBy("pattern").agg(F.count("*").alias("n"))


def b4_wallets(spark, d):
    return B.explode_wallets(observations(spark, d)).groupBy("wallet").agg(F.count("*").alias("n"))


def b5_broad_action(spark, d):
    return observations(spark, d).groupBy(B.broad_action(F.col("motif")).alias("action")).agg(F.count("*").alias("n"))


def b6_levels(spark, d):
    return _levels(spark, d).groupBy("level", "scope_type", "intent_label").agg(F.count("*").alias("n"), F.count_distinct("pattern").alias("n_patterns"))


def b7_stats(spark, d):
    return _stats(spark, d).select(*B.GROUP, "n", *[F.round(c, 6).alias(c) for c in ("mean_return", "median_return", "std_return")], "negative_count", "positive_count")


def b8_bootstrap(spark, d):
    return S.bootstrap_ci(observations(spark, d), ["entity_id", "asset_key", "horizon_seconds"], "simple_return", samples=1000)


def b9_sign_test(spark, d):
    return _stats(spark, d).select(*B.GROUP, _millionths(S.sign_test(F.col("negative_count"), F.col("positive_count"))).alias("p"))


def b10_bh(spark, d):
    rated = _stats(spark, d).withColumn("p", F.round(S.sign_test(F.col("negative_count"), F.col("positive_count")), 9))
    return S.bh_qvalues(rated, [], "p").select(*B.GROUP, F.round("qvalue", 6).alias("qvalue"))


def b11_holdout(spark, d):
    found = B.holdouts(B.nested(*_inputs(spark, d)))
    return found.select(*B.GROUP, "train_n", "test_n", *[F.round(c, 6).alias(c) for c in ("train_mean", "test_mean_return", "holdout_accuracy")])


def b12_shrinkage(spark, d):
    found = B.backtest(*_inputs(spark, d), samples=0)
    return found.select(*B.GROUP, *[F.round(c, 6).alias(c) for c in ("prior_mean", "shrunk_mean")])


def b13_support(spark, d):
    return _stats(spark, d).select(*B.GROUP, "n")


def b14_mixed_assets(spark, d):
    return B.mixed_assets(B.nested(*_inputs(spark, d)))


def b15_backtest(spark, d):
    found = B.backtest(*_inputs(spark, d), samples=0)
    rounded = ("mean_return", "median_return", "std_return", "prior_mean", "shrunk_mean", "negative_rate", "positive_rate", "train_mean", "test_mean_return", "holdout_accuracy")
    return found.select(*[c for c in B.GROUP if c != "pattern"], "motif", "n", "train_n", "test_n", *[F.round(c, 6).alias(c) for c in rounded], _millionths(F.col("sign_pvalue")).alias("sign_pvalue"))


def b15_intervals(spark, d):
    """The whole report, with the intervals, which are drawn and have no twin."""
    return B.backtest(*_inputs(spark, d))


def b16_scopes(spark, d):
    """Which wallets and entities a group's scope names."""
    return _levels(spark, d).select("scope_type", "scope_id", "entity_id", "level").distinct()


def _new(spark, d, layer="primary", half=None):
    labels = day_labels(spark, d)
    ep = day_episodes(spark, d)
    ep = ep if half is None else ep.where(F.floor(F.col("start_ts") / 3600) % 2 == half)
    return I.new_observations(ep, labels, labels.where("false"), layer)


def i1_canonical(spark, d):
    found = F.when(F.size("patterns") % 2 == 0, F.filter("patterns", lambda p: p.startswith("ENDPOINT") | p.startswith("FULL"))).otherwise(F.array().cast("array<string>"))
    return day_episodes(spark, d).select("episode_id", F.array_join(P.canonical_patterns(found, F.col("motif")), ";").alias("patterns"))


def _dealt(spark, d):
    """Observations for statistics of whole groups, dealt as these need them, and a bound on a group's rows: an episode is at most once in a group, and groups mix neither entities nor assets."""
    return _dealt_of(*_taken(spark, d))


def _taken(spark, d):
    ep = materialize(spread(day_episodes(spark, d), "episode_id"), "episodes")
    return ep, M.forward_returns(ep, X.prices(spark, d), HORIZONS, {})


def _dealt_of(ep, labels):
    most = ep.groupBy("entity_id", "asset_key").count().agg(F.max("count")).first()[0] or 0
    return I.new_observations(ep, labels, labels.where("false"), dealt=True), most


def _refreshed(spark, d, **how):
    """The family refreshed; priors come from the labels, before patterns multiply them."""
    ep, labels = _taken(spark, d)
    obs, most = _dealt_of(ep, labels)
    each = labels.where("simple_return is not null").select("episode_id", "asset_key", "horizon_seconds", "simple_return").join(ep.where(F.size("patterns") > 0).select("episode_id", "entity_id", F.lit("").alias("intent_label")), "episode_id")
    prior = each.groupBy(*I.SCOPE).agg(F.avg("simple_return").alias("_prior"))
    return I.refresh_stats(_last_seen(I.aggregate(obs)), obs, at_most=most, prior=prior, **how)


def i2_new_observations(spark, d):
    labels = day_labels(spark, d)
    seen = labels.where("horizon_seconds = 3600").select("episode_id", "asset_key", "horizon_seconds")
    return I.new_observations(day_episodes(spark, d), labels, seen, "secondary", 1704200000, 1706000000).select("observation_key", "pattern_key", "layer", "intent_label")


def i3_keys(spark, d):
    return _new(spark, d).select("observation_key", "pattern_key")


def i4_delta_merge(spark, d):
    merged = I.merge_aggregates(I.aggregate(_new(spark, d, half=0)), I.aggregate(_new(spark, d, half=1)))
    return merged.select("pattern_key", "n", F.round("sum_return", 4).alias("sum_return"), F.round("mean_return", 6).alias("mean_return"), "negative_count", "positive_count", "maturity")


def i5_rebuild(spark, d):
    obs = _new(spark, d)
    dirty = obs.where("entity_id = 'ent_1'").select("pattern_key").distinct()
    rebuilt = I.rebuild_groups(I.aggregate(obs), obs.where("entity_id != 'ent_1' or horizon_seconds > 3600"), dirty)
    return rebuilt.groupBy("entity_id", "horizon_seconds").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


def i6_checkpoints(spark, d):
    obs, most = _dealt(spark, d)
    found = I.checkpoints(obs, samples=0, at_most=most)
    return found.select("pattern_key", "n", "maturity", *[F.round(c, 6).alias(c) for c in ("mean_return", "median_return", "negative_rate")])


def i6_intervals(spark, d):
    """Checkpoints with their intervals, which are drawn and have no twin."""
    obs, most = _dealt(spark, d)
    return I.checkpoints(obs, at_most=most)


def i7_stale(spark, d):
    left = day_episodes(spark, d).where("entity_id != 'ent_2'")
    return I.drop_stale(_new(spark, d), left).select("observation_key", "entity_id")


def i8_dirty_keys(spark, d):
    return I.dirty_keys(_new(spark, d), day_episodes(spark, d).where("start_ts < 1704200000"))


def _aggregates(spark, d):
    return _last_seen(I.aggregate(_new(spark, d)))


def _last_seen(agg):
    return agg.withColumn("last_expensive_n", F.when(F.col("horizon_seconds") == 3600, F.greatest(F.col("n") - 3, F.lit(10))).when(F.col("horizon_seconds") == 21600, F.greatest(F.col("n") - 12, F.lit(10))))


def i9_due_groups(spark, d):
    return I.due_groups(_aggregates(spark, d)).select("pattern_key", "n")


def i10_refresh(spark, d):
    found = _refreshed(spark, d, samples=0).where("train_n is not null")
    return found.select("pattern_key", "n", "train_n", "test_n", "last_expensive_n", *[F.round(c, 6).alias(c) for c in ("median_return", "shrunk_mean", "train_mean", "test_mean_return", "holdout_accuracy")])


def i10_intervals(spark, d):
    """The refreshed state with its intervals, which are drawn and have no twin, and the maturity that follows from them."""
    return _refreshed(spark, d)


def i11_family(spark, d):
    found = _refreshed(spark, d, samples=0)
    return found.select("pattern_key", F.col("sign_pvalue").isNull().alias("untested"), F.round("qvalue", 6).alias("qvalue"))


def _mature(spark, d):
    keys = ["scope_id", "pattern", "asset_key", "horizon_seconds"]
    rows = _levels(spark, d).where("level = 'entity_action'")
    stats = S.summary(rows, keys, "simple_return").join(S.holdout(rows, keys, "simple_return", ["start_ts", "episode_id"]), keys)
    half = 1.96 * F.col("std_return") / F.sqrt("n")
    return stats.withColumn("lo", F.col("mean_return") - half).withColumn("hi", F.col("mean_return") + half).withColumn("q", S.sign_test(F.col("negative_count"), F.col("positive_count")))


def i12_maturity(spark, d):
    c = F.col
    level = I.maturity(c("n"), c("lo"), c("hi"), c("q"), c("holdout_accuracy"), c("train_mean"), c("test_mean_return"))
    return _mature(spark, d).select("scope_id", "pattern", "asset_key", "horizon_seconds", "n", level.alias("maturity"))


def i13_train_mean(spark, d):
    c = F.col
    return _mature(spark, d).select("scope_id", "pattern", "asset_key", "horizon_seconds", F.round(I.train_mean(c("mean_return"), c("n"), c("test_mean_return"), c("test_n"), c("train_n")), 6).alias("train_mean"))


def i14_change_feed(spark, d):
    before, now = I.aggregate(_new(spark, d, half=0)), I.aggregate(_new(spark, d))
    stage = F.when(F.col("n") >= 20, "PROMISING").otherwise("EARLY")
    return I.change_feed(before.withColumn("maturity", stage), now.withColumn("maturity", stage)).groupBy("kind", "detail").agg(F.count("*").alias("n"))


def i15_fingerprint(spark, d):
    return I.fingerprint(_new(spark, d), _new(spark, d, "secondary"))


def i16_candidates(spark, d):
    ev = X.events(spark, d).withColumn("tx_hash", F.when(F.col("k") % 5 != 0, F.concat(F.lit("tx"), "event_id")))
    return I.enrich_candidates(ev, ev.where("k % 3 = 0"), 50.0, 300)


def i17_invalidated(spark, d):
    ev = X.events(spark, d).withColumn("tx_hash", F.concat(F.lit("tx"), F.col("event_id").cast("long") % 100))
    return I.invalidate_events(ev, ev.where("k = 3"), ["tx_hash", "chain"])


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] in "bi" and name[1:2].isdigit()} | {"q0_flagship": q0_flagship}

_NEW = f"""{DAYS}, nw AS (SELECT o.episode_id, entity_id, p AS pattern, '' AS intent_label, asset_key, horizon_seconds, start_ts, simple_return AS r,
  sha256('primary|' || o.episode_id || '|' || asset_key || '|' || horizon_seconds || '|' || p) AS observation_key, sha256(entity_id || '|' || p || '||' || asset_key || '|' || horizon_seconds) AS pattern_key FROM (SELECT *, unnest(patterns) AS p FROM obs) o)"""
_AGG = f"{_NEW}, ag AS (SELECT pattern_key, entity_id, asset_key, horizon_seconds, count(*) AS n, sum(r) AS s, count(*) FILTER (r < 0) AS neg, count(*) FILTER (r > 0) AS pos FROM nw GROUP BY ALL)"
_DUE = f"{_AGG}, le AS (SELECT *, CASE horizon_seconds WHEN 3600 THEN greatest(n - 3, 10) WHEN 21600 THEN greatest(n - 12, 10) END AS last FROM ag), du AS (SELECT * FROM le WHERE n >= 10 AND (last IS NULL OR n >= least(last + 10, ceil(last * 1.2))))"
_SPLIT = "train_n, test_n, tm, sm, CASE WHEN test_n > 0 THEN CASE WHEN tm < 0 THEN neg2 ELSE pos2 END / test_n END AS acc"


def _holdout_sql(source: str, keys: str, value: str, order: str) -> str:
    return f"""SELECT {keys}, {_SPLIT} FROM (SELECT {keys}, count(*) FILTER (i <= cut) AS train_n, count(*) FILTER (i > cut) AS test_n, avg({value}) FILTER (i <= cut) AS tm, avg({value}) FILTER (i > cut) AS sm,
      count(*) FILTER (i > cut AND {value} < 0) AS neg2, count(*) FILTER (i > cut AND {value} > 0) AS pos2 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i,
      greatest(1, floor(count(*) OVER (PARTITION BY {keys}) * 0.7 + 1e-9)) AS cut FROM {source}) GROUP BY {keys})"""


_KS = "scope_id, pattern, asset_key, horizon_seconds"
_MATURE = f"""{DAYS}, ea AS (SELECT * FROM lvl WHERE level = 'entity_action'), ms AS (SELECT {_KS}, count(*) AS n, avg(simple_return) AS mean, coalesce(stddev_samp(simple_return), 0) AS sd, count(*) FILTER (simple_return < 0) AS neg, count(*) FILTER (simple_return > 0) AS pos FROM ea GROUP BY ALL),
  mh AS ({_holdout_sql("ea", _KS, "simple_return", "start_ts, episode_id")}), mm AS (SELECT *, mean - 1.96 * sd / sqrt(n) AS lo, mean + 1.96 * sd / sqrt(n) AS hi, {_TAIL} AS q FROM ms JOIN mh USING ({_KS}))"""
#: Groups with their prior: of entity, asset and horizon, and of intent too where the level has one.
_REPORT = f"""{GROUPS}, pl AS (SELECT entity_id, asset_key, horizon_seconds, avg(simple_return) AS plain FROM obs GROUP BY ALL), pi AS (SELECT entity_id, intent_label, asset_key, horizon_seconds, avg(simple_return) AS own FROM obs GROUP BY ALL),
  rep AS (SELECT *, coalesce(CASE WHEN intent_label = '' THEN plain ELSE own END, (SELECT avg(simple_return) FROM obs)) AS prior FROM grp LEFT JOIN pl USING (entity_id, asset_key, horizon_seconds) LEFT JOIN pi USING (entity_id, intent_label, asset_key, horizon_seconds))"""

ORACLES = {
    "q0_flagship": f"""WITH {DAYS}, grp AS (SELECT entity_id, pattern, count(*) AS n, avg(simple_return) AS mean_return, median(simple_return) AS median_return, count(*) FILTER (simple_return < 0) AS neg, count(*) FILTER (simple_return > 0) AS pos FROM pat WHERE horizon_seconds = {DAY} GROUP BY ALL HAVING count(*) >= 3),
      sgn AS (SELECT *, {_TAIL} AS p FROM grp), rnk AS (SELECT *, rank() OVER (ORDER BY round(p, 9)) + count(*) OVER (PARTITION BY round(p, 9)) - 1 AS r, count(*) OVER () AS m FROM sgn)
      SELECT entity_id, pattern, n, round(mean_return, 6) AS mean_return, round(median_return, 6) AS median_return, neg AS negative_count, pos AS positive_count, {_MILLIONTHS} AS p, round(min(least(1.0, p * m / r)) OVER (ORDER BY round(p, 9) DESC RANGE UNBOUNDED PRECEDING), 6) AS qvalue FROM rnk""",
    "b1_observations": f"WITH {DAYS} SELECT episode_id, asset_key, horizon_seconds, round(simple_return, 6) AS simple_return, intent_label, regime FROM obs",
    "b2_one_source": f"WITH {DAYS} SELECT episode_id, asset_key, horizon_seconds, round(simple_return + 1, 6) AS simple_return FROM obs",
    "b3_regime_patterns": f"WITH {DAYS} SELECT pattern, count(*) AS n FROM pat GROUP BY 1",
    "b4_wallets": f"WITH {DAYS} SELECT wallet, count(*) AS n FROM obs GROUP BY 1",
    "b5_broad_action": f"WITH {DAYS} SELECT split_part(motif, '>', 1) AS action, count(*) AS n FROM obs GROUP BY 1",
    "b6_levels": f"WITH {DAYS} SELECT level, scope_type, intent_label, count(*) AS n, count(DISTINCT pattern) AS n_patterns FROM lvl GROUP BY 1, 2, 3",
    "b7_stats": f"WITH {GROUPS} SELECT {G}, n, round(mean_return, 6) AS mean_return, round(median_return, 6) AS median_return, round(std_return, 6) AS std_return, neg AS negative_count, pos AS positive_count FROM grp",
    "b9_sign_test": f"WITH {SIGNS} SELECT {G}, {_MILLIONTHS} AS p FROM sgn",
    "b10_bh": f"""WITH {GROUPS}, sgn AS (SELECT *, round({_TAIL}, 9) AS p FROM grp), rnk AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM sgn)
      SELECT {G}, round(min(least(1.0, p * m / r)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 6) AS qvalue FROM rnk""",
    "b11_holdout": f"WITH {DAYS}, h AS ({_holdout_sql('lvl', G, 'simple_return', 'start_ts, episode_id')}) SELECT {G}, train_n, test_n, round(tm, 6) AS train_mean, round(sm, 6) AS test_mean_return, round(acc, 6) AS holdout_accuracy FROM h",
    "b12_shrinkage": f"WITH {_REPORT} SELECT {G}, round(prior, 6) AS prior_mean, round((n * mean_return + 20 * prior) / (n + 20), 6) AS shrunk_mean FROM rep",
    "b13_support": f"WITH {GROUPS} SELECT {G}, n FROM grp",
    "b14_mixed_assets": f"WITH {DAYS}, a AS (SELECT level, scope_id, pattern, intent_label, horizon_seconds, count(DISTINCT asset_key) AS c FROM lvl GROUP BY ALL) SELECT level, scope_id, pattern, intent_label, horizon_seconds, c AS assets FROM a WHERE c > 1",
    "b15_backtest": f"""WITH {_REPORT}, h AS ({_holdout_sql("lvl", G, "simple_return", "start_ts, episode_id")}) SELECT {", ".join(c for c in B.GROUP if c != "pattern")}, level || ':' || pattern AS motif, n, train_n, test_n,
      round(mean_return, 6) AS mean_return, round(median_return, 6) AS median_return, round(std_return, 6) AS std_return, round(prior, 6) AS prior_mean, round((n * mean_return + 20 * prior) / (n + 20), 6) AS shrunk_mean, round(neg / n, 6) AS negative_rate,
      round(pos / n, 6) AS positive_rate, round(tm, 6) AS train_mean, round(sm, 6) AS test_mean_return, round(acc, 6) AS holdout_accuracy, {_MILLIONTHS} AS sign_pvalue FROM (SELECT *, {_TAIL} AS p FROM rep) JOIN h USING ({G})""",
    "b16_scopes": f"WITH {DAYS} SELECT DISTINCT scope_type, scope_id, entity_id, level FROM lvl",
    "i1_canonical": f"""WITH {DAYS}, g AS (SELECT episode_id, motif, CASE WHEN len(patterns) % 2 = 0 THEN list_filter(patterns, lambda p: starts_with(p, 'ENDPOINT') OR starts_with(p, 'FULL')) ELSE [] END AS f FROM epd),
      h AS (SELECT episode_id, motif, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['FULL:' || motif] END) AS v FROM g), k AS (SELECT episode_id, motif, split_part(v, ':', 1) AS p, substr(v, strpos(v, ':') + 1) AS b FROM h),
      c AS (SELECT episode_id, CASE WHEN p = 'FULL' AND len(string_split(b, '>')) <= 3 THEN ['ACTION', 'BIGRAM', 'TRIGRAM'][len(string_split(b, '>'))] WHEN p = 'ENDPOINT' AND len(string_split(motif, '>')) = 2 AND b = motif THEN 'BIGRAM' ELSE p END || ':' || b AS x FROM k)
      SELECT episode_id, string_agg(DISTINCT x, ';' ORDER BY x) AS patterns FROM c GROUP BY 1""",
    "i2_new_observations": f"WITH {DAYS} SELECT sha256(episode_id || '|' || asset_key || '|' || horizon_seconds || '|' || p) AS observation_key, sha256(entity_id || '|' || p || '|' || intent || '|' || asset_key || '|' || horizon_seconds) AS pattern_key, 'secondary' AS layer, intent AS intent_label FROM (SELECT *, unnest(patterns) AS p FROM obs WHERE intent IS NOT NULL AND horizon_seconds <> 3600 AND start_ts BETWEEN 1704200000 AND 1706000000)",
    "i3_keys": f"WITH {_NEW} SELECT observation_key, pattern_key FROM nw",
    "i4_delta_merge": f"WITH {_AGG} SELECT pattern_key, n, round(s, 4) AS sum_return, round(s / n, 6) AS mean_return, neg AS negative_count, pos AS positive_count, CASE WHEN n >= 20 THEN 'PROMISING' ELSE 'EARLY' END AS maturity FROM ag",
    "i5_rebuild": f"WITH {_NEW} SELECT entity_id, horizon_seconds, count(DISTINCT pattern_key) AS groups, count(*) AS n FROM nw WHERE entity_id <> 'ent_1' OR horizon_seconds > 3600 GROUP BY 1, 2",
    "i6_checkpoints": f"""WITH {_NEW}, p AS (SELECT *, row_number() OVER (PARTITION BY pattern_key ORDER BY start_ts, observation_key) AS i, count(*) OVER (PARTITION BY pattern_key) AS c FROM nw), m AS (SELECT unnest({list(I.MILESTONES)}) AS mark)
      SELECT pattern_key, mark AS n, CASE WHEN mark < 20 THEN 'EARLY' ELSE 'PROMISING' END AS maturity, round(avg(r), 6) AS mean_return, round(median(r), 6) AS median_return, round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0 END), 6) AS negative_rate FROM p JOIN m ON i <= mark AND c >= mark GROUP BY 1, 2""",
    "i7_stale": f"WITH {_NEW} SELECT observation_key, entity_id FROM nw WHERE entity_id <> 'ent_2'",
    "i8_dirty_keys": f"WITH {_NEW} SELECT DISTINCT pattern_key FROM nw WHERE start_ts < 1704200000",
    "i9_due_groups": f"WITH {_DUE} SELECT pattern_key, n FROM du",
    "i10_refresh": f"""WITH {_DUE}, ow AS (SELECT nw.* FROM nw JOIN du USING (pattern_key)), h AS ({_holdout_sql('ow', 'pattern_key', 'r', 'start_ts, observation_key')}), dp AS (SELECT entity_id, asset_key, horizon_seconds, avg(r) AS prior FROM (SELECT DISTINCT entity_id, asset_key, horizon_seconds, episode_id, r FROM nw) GROUP BY ALL)
      SELECT pattern_key, n, train_n, test_n, n AS last_expensive_n, round(med, 6) AS median_return, round((s + 20 * prior) / (n + 20), 6) AS shrunk_mean, round(tm, 6) AS train_mean, round(sm, 6) AS test_mean_return, round(acc, 6) AS holdout_accuracy
      FROM du JOIN h USING (pattern_key) JOIN dp USING (entity_id, asset_key, horizon_seconds) JOIN (SELECT pattern_key, median(r) AS med FROM ow GROUP BY 1) USING (pattern_key)""",
    "i11_family": f"""WITH {_DUE}, f AS (SELECT ag.pattern_key, du.pattern_key IS NULL AS untested, CASE WHEN du.pattern_key IS NULL THEN 1.0 ELSE (SELECT {_TAIL} FROM (SELECT ag.neg AS neg, ag.pos AS pos)) END AS p FROM ag LEFT JOIN du USING (pattern_key)),
      rnk AS (SELECT *, rank() OVER (ORDER BY round(p, 12)) + count(*) OVER (PARTITION BY round(p, 12)) - 1 AS r, count(*) OVER () AS m FROM f), q AS (SELECT *, min(least(1.0, p * m / r)) OVER (ORDER BY round(p, 12) DESC RANGE UNBOUNDED PRECEDING) AS q FROM rnk)
      SELECT pattern_key, untested, round(q, 6) AS qvalue FROM q""",
    "i12_maturity": f"""WITH {_MATURE} SELECT {_KS}, n, CASE WHEN n < 20 THEN 'EARLY' WHEN n >= 100 AND (lo > 0 OR hi < 0) AND q <= 0.05 AND tm * sm > 0 AND coalesce(acc, 0) >= 0.6 THEN 'ROBUST' WHEN n >= 50 AND (lo > 0 OR hi < 0) AND tm * sm > 0 AND coalesce(acc, 0) >= 0.55 THEN 'ESTABLISHING' ELSE 'PROMISING' END AS maturity FROM mm""",
    "i13_train_mean": f"WITH {_MATURE} SELECT {_KS}, round(tm, 6) AS train_mean FROM mm",
    "i14_change_feed": f"""WITH {_NEW}, c AS (SELECT pattern_key, count(*) AS n, count(*) FILTER ((start_ts // 3600) % 2 = 0) AS b FROM nw GROUP BY 1), m AS (SELECT pattern_key, max(mark) AS m FROM c, (SELECT unnest({list(I.MILESTONES)}) AS mark) WHERE mark > b AND mark <= n GROUP BY 1)
      SELECT kind, detail, count(*) AS n FROM (SELECT 'sample' AS kind, CAST(n AS VARCHAR) AS detail FROM c WHERE n - b >= 5 UNION ALL SELECT 'milestone', CAST(m AS VARCHAR) FROM m UNION ALL SELECT 'maturity', 'PROMISING' FROM c WHERE b > 0 AND b < 20 AND n >= 20) GROUP BY 1, 2""",
    "i16_candidates": f"WITH {EV} SELECT 'tx' || event_id AS tx_hash, chain, usd_value FROM ev WHERE k % 5 <> 0 AND k % 3 <> 0 AND usd_value >= 50 ORDER BY usd_value DESC, tx_hash, chain LIMIT 300",
    "i17_invalidated": f"WITH {EV}, t AS (SELECT *, 'tx' || (CAST(event_id AS BIGINT) % 100) AS tx_hash FROM ev) SELECT event_id FROM t WHERE (tx_hash, chain) IN (SELECT (tx_hash, chain) FROM t WHERE k = 3)",
    "i15_fingerprint": f"WITH {_NEW} SELECT sha256((SELECT count(*) FROM nw) || '|' || (SELECT CAST(sum(len(patterns)) AS BIGINT) FROM obs WHERE intent IS NOT NULL)) AS fingerprint",
}
