"""Registered queries on reports and on landing data, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import normalize as N
from tracewright.operators import explore as Q
from tracewright.operators import incremental as I
from tracewright.operators import market as M
from tracewright.operators import windows as W
from tracewright.plans import statistics as T
from tracewright.plans.markets import _STATE, episodes, labels
from tracewright.sources import fixtures as X
from tracewright.sources import ingest as G
from tracewright.sources.fixtures import EV, HORIZONS, LEGS, NOW, ORD
from tracewright.sources.shared import scratch

DAY = 86400


def _aggregates(spark, d):
    """Groups with made-up but fixed statistics on top of their counts, from the account-day observations."""
    agg = I.merge_aggregates(I.aggregate(T._new(spark, d)), I.aggregate(T._new(spark, d)).where("false"))
    stage = F.when(F.col("n") >= 100, "ROBUST").when(F.col("n") >= 50, "ESTABLISHING").when(F.col("n") >= 20, "PROMISING").otherwise("EARLY")
    return agg.select("pattern_key", "entity_id", "pattern", "intent_label", "asset_key", "horizon_seconds", "n", F.round("mean_return", 6).alias("mean_return"), "negative_count", "positive_count", stage.alias("maturity"), F.when(F.col("n") % 2 == 0, F.col("positive_count") / F.col("n")).alias("holdout_accuracy"), F.when(F.col("n") % 3 == 0, 0.01).alias("qvalue"), F.lit(None).cast("double").alias("shrunk_mean"))


def _assets(spark, d):
    return X.events(spark, d).select(F.col("primary_asset_key").alias("asset_key")).distinct().select("asset_key", F.upper(F.substring("asset_key", 7, 3)).alias("symbol"), F.initcap(F.substring("asset_key", 7, 10)).alias("name"))


_AG = f"""{T._AGG}, pn AS (SELECT DISTINCT pattern_key, pattern FROM nw), g AS (SELECT pattern_key, entity_id, pattern, asset_key, horizon_seconds, n, round(s / n, 6) AS mean_return, neg AS negative_count, pos AS positive_count,
  CASE WHEN n >= 100 THEN 3 WHEN n >= 50 THEN 2 WHEN n >= 20 THEN 1 ELSE 0 END AS stage, CASE WHEN n % 2 = 0 THEN pos / n END AS acc, CASE WHEN n % 3 = 0 THEN 0.01 END AS q FROM ag JOIN pn USING (pattern_key))"""
_SCORE = "n / (n + 20) * (1 + least(abs(mean_return), 1.0)) * (1 + coalesce(acc, 0)) * (1 + CASE WHEN q <= 0.05 THEN 1 ELSE 0 END)"


def q1_explorer(spark, d):
    found = Q.explore(_aggregates(spark, d), _assets(spark, d), min_n=4, max_n=400, entity="ent_1", kind="BIGRAM", horizon=DAY, search="purchase", sort="sample")
    return found.select("pattern_key", "pattern", "n")


def q2_rank(spark, d):
    return Q.explore(_aggregates(spark, d), _assets(spark, d), limit=50).select("pattern_key", "n", F.round(Q.rank_score(), 4).alias("score"))


def q3_orders(spark, d):
    return Q.explore(_aggregates(spark, d), _assets(spark, d), sort="hit", offset=10, limit=40).select("pattern_key", "n", "negative_count", "positive_count")


def q4_dashboard(spark, d):
    return Q.top_patterns(_aggregates(spark, d)).select("pattern_key", "n", "maturity")


def q5_display(spark, d):
    found = Q.display(_aggregates(spark, d), _assets(spark, d).where("symbol != 'PUR'"))
    return found.select("pattern_key", F.round("negative_rate", 6).alias("negative_rate"), F.round("positive_rate", 6).alias("positive_rate"), "direction", "asset_label", "asset_chain")


def q6_observations(spark, d):
    obs = T._new(spark, d).where("pattern = 'ACTION:CONTRACT_INTERACTION'")
    return Q.latest_n(obs, [F.desc("episode_ts"), F.desc("observation_key")], 200).select("observation_key", "episode_ts", F.round("return_value", 6).alias("return_value"))


def q7_horizon_profile(spark, d):
    return Q.horizon_profile(T._new(spark, d), ["entity_id", "pattern"]).select("entity_id", "pattern", "horizon_seconds", "n", F.round("mean_return", 6).alias("mean_return"))


def q8_histogram(spark, d):
    found = W.histogram(X.events(spark, d), ["entity_id", "primary_asset_key"], "usd_value")
    return found.select("entity_id", "primary_asset_key", "bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


def q9_checkpoint_series(spark, d):
    return I.checkpoints(T._new(spark, d), (10, 25, 50), samples=0).select("pattern_key", "n", "maturity")


def q10_evidence(spark, d):
    ep = T.day_episodes(spark, d)
    return Q.episode_evidence(ep, ep.where("entity_id in ('ent_0', 'ent_3')").select("episode_id"), 1704300000, 1705000000).select("episode_id", "motif", F.array_join("patterns", ";").alias("patterns"))


def _ledger(spark, d):
    """One coverage row per account, from its events."""
    return X.events(spark, d).groupBy("entity_id", "wallet", "chain").agg(F.min("ts").alias("covered_from"), F.max("ts").alias("covered_to"), F.count("*").alias("pages"), F.when(F.max("k") > 90, "complete").otherwise("partial").alias("state"))


def _requests(spark, d):
    """A request log: one row per event."""
    status = F.when(F.col("k") % 10 == 0, 500).when(F.col("k") % 10 == 1, 404).otherwise(200)
    return X.events(spark, d).select("entity_id", F.col("action_type").alias("endpoint"), F.concat(F.lit("r"), F.col("k") % 20).alias("request"), status.alias("status"), F.col("ts").alias("fetched_at"), (F.col("k") % 3).alias("cursor"), F.col("event_id").cast("long").alias("response_id"), F.col("usd_value").alias("seconds"))


_LEDGER = "led AS (SELECT entity_id, wallet, chain, min(ts) AS covered_from, max(ts) AS covered_to, count(*) AS pages, CASE WHEN max(k) > 90 THEN 'complete' ELSE 'partial' END AS state FROM ev GROUP BY 1, 2, 3)"
_LOG = "log AS (SELECT entity_id, action_type AS endpoint, 'r' || (k % 20) AS request, CASE k % 10 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS status, ts AS fetched_at, k % 3 AS cursor, CAST(event_id AS BIGINT) AS response_id, usd_value AS seconds FROM ev)"


def q11_quality(spark, d):
    ep = episodes(spark, d).withColumn("intent_label", F.when(F.col("k") % 5 == 0, "unknown").when(F.col("k") % 5 < 4, "buy")).withColumn("confidence", F.when(F.col("k") % 5 < 4, F.col("k") / 100))
    found = Q.quality_report(ep, M.horizon_states(labels(spark, d), NOW), _ledger(spark, d), _requests(spark, d))
    return found.withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn("request_success", F.round("request_success", 6))


def q12_counters(spark, d):
    return Q.run_counters(X.events(spark, d), T.day_episodes(spark, d), T.day_labels(spark, d))


def q13_backlog(spark, d):
    ep, lab = T.day_episodes(spark, d), T.day_labels(spark, d)
    obs = I.new_observations(ep, lab.where("horizon_seconds <= 3600"), lab.where("false"))
    return Q.backlog(X.events(spark, d).where("k % 9 = 0"), ep, M.horizon_states(lab, NOW), lab, obs, I.due_groups(T._aggregates(spark, d)))


def q14_progress(spark, d):
    shares = X.events(spark, d).groupBy("entity_id").agg(F.avg((F.col("k") < 80).cast("double")).alias("a"), F.avg((F.col("k") < 50).cast("double")).alias("b"), F.avg(F.col("k") / 40).alias("c"))
    return shares.select("entity_id", F.round(Q.progress(F.col("a"), [F.col("b"), F.col("c")]), 6).alias("progress"))


def q15_top_tokens(spark, d):
    legs = X.legs(spark, d).join(X.order_events(spark, d).select("event_id", "wallet", "chain", "ts"), "event_id").withColumn("usd", N.leg_usd(F.col("amount"), F.col("price"))).withColumn("seq", F.struct("ts", "event_id", "pos"))
    return Q.top_tokens(legs, 3)


def q16_entity_cap(spark, d):
    return W.cap_per_key(X.events(spark, d), "entity_id", [F.desc("usd_value"), F.asc("event_id")], 7).select("entity_id", "event_id", "usd_value")


def _memberships(spark, d):
    ev = X.events(spark, d)
    one = lambda name, cond: ev.where(cond).select("entity_id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("0xABC"), "wallet")).otherwise(F.concat(F.lit("Sol"), "wallet")).alias("address"), "chain", F.lit(name).alias("source"), (F.col("k") / 100).alias("confidence"), F.col("event_id").alias("meta"), F.struct("ts", "event_id").alias("updated_at"))
    return [one("top", "k < 40"), one("search", "k between 30 and 70"), one("perp", "k > 60"), one("owner", "k % 10 = 5")]


_MEMBERS = "mem AS (SELECT entity_id, CASE WHEN k % 2 = 0 THEN lower('0xABC' || wallet) ELSE 'Sol' || wallet END AS address, chain, unnest(list_filter([CASE WHEN k < 40 THEN 'top' END, CASE WHEN k BETWEEN 30 AND 70 THEN 'search' END, CASE WHEN k > 60 THEN 'perp' END, CASE WHEN k % 10 = 5 THEN 'owner' END], lambda x: x IS NOT NULL)) AS source, k / 100 AS confidence, event_id, ts FROM ev)"


def q17_provenance(spark, d):
    return Q.dedupe_provenance(G.membership(_memberships(spark, d)))


def q18_latest(spark, d):
    return Q.latest_n(X.events(spark, d).where("action_type = 'CONTRACT_INTERACTION'"), [F.desc("ts"), F.desc("event_id")], 30).select("event_id", "ts")


def _runs(spark, d):
    return X.events(spark, d).groupBy("entity_id").agg((F.floor(F.min("ts") / DAY) * DAY).alias("from_ts"), (F.floor((F.min("ts") + 9 * DAY) / DAY) * DAY).alias("to_day_ts")).withColumn("run_id", F.concat(F.lit("run_"), "entity_id"))


def q19_runs(spark, d):
    runs = _runs(spark, d)
    return Q.run_list(runs.select("run_id", "entity_id"), G.enroll(X.events(spark, d), runs))


def q20_requests(spark, d):
    return Q.request_summary(_requests(spark, d))


def s1_archive(spark, d):
    raw = X.events(spark, d).select(F.col("action_type").alias("provider"), (F.floor(F.col("ts") / DAY)).alias("day"), F.concat(F.lit('{"w":"'), "wallet", F.lit('","k":'), F.col("k") % 7, F.lit("}")).alias("payload"))
    raw = raw.groupBy("payload").agg(F.min(F.struct("provider", "day")).alias("v")).select("v.provider", "v.day", "payload")
    path = scratch(spark, "archive")
    G.write_archive(raw.where("day % 2 = 0"), path)
    G.write_archive(raw, path)
    back = G.read_archive(spark, path, "payload string, sha256 string, provider string, day long")
    return back.select("provider", "day", "payload", "sha256")


def s2_latest_valid(spark, d):
    return G.latest_valid(_requests(spark, d), 1706000000).select("endpoint", "request", "response_id")


def _pages(spark, d):
    """History pages of an account's five days as JSON, with legs, a transaction and dictionaries for exchanges and projects; categories are known for half of the rows."""
    ev = X.events(spark, d).withColumn("cate_id", F.concat(F.lit("cate"), F.col("k") % 4))
    leg = lambda token, other: F.array(F.struct(F.col("k").cast("double").alias("amount"), F.col("usd_value").alias("price"), F.lit(token).alias("token_id"), F.lit("0xother").alias(other)))
    sends, receives = F.when(F.col("k") % 3 != 0, leg("0xToken", "to_addr")), F.when(F.col("k") % 3 != 1, leg("eth", "from_addr"))
    row = F.struct(
        F.when(F.col("k") % 5 != 0, F.col("event_id")).alias("id"), F.col("k").alias("idx"), F.when(F.col("k") % 8 == 0, F.lit("bad")).otherwise(F.concat("ts", F.lit(".5"))).alias("time_at"), "cate_id", "cex_id", "project_id",
        sends.alias("sends"), receives.alias("receives"), F.struct(F.concat(F.lit("tx"), "event_id").alias("id")).alias("tx"), F.when(F.col("k") % 17 == 0, "token").alias("token_approve"),
    )
    names = lambda c, keep: F.map_from_entries(F.array_compact(F.array_distinct(F.collect_list(F.when(F.col(c).isNotNull() & keep, F.struct(F.col(c), F.struct(F.upper(c).alias("name"))))))))
    dicts = {"cate_dict": names("cate_id", F.col("cate_id") < "cate2"), "cex_dict": names("cex_id", F.lit(True)), "project_dict": names("project_id", F.lit(True))}
    grouped = ev.groupBy("entity_id", "wallet", "chain", F.floor(F.col("ts") / (5 * DAY)).alias("page")).agg(F.collect_list(row).alias("history_list"), *[v.alias(k) for k, v in dicts.items()])
    return grouped.select("entity_id", "wallet", "chain", F.to_json(F.struct("history_list", *dicts)).alias("payload"))


def s3_history_flatten(spark, d):
    return G.flatten_pages(_pages(spark, d)).select("wallet", "id", "idx", "ts", "cate_name", "cex_name", "project_name")


def s3_normalized_events(spark, d):
    found = G.normalize_pages(_pages(spark, d))
    return found.select("event_id", "wallet", "chain", "tx_hash", "event_index", "ts", "action_type", "cate_name", "cex_name", "project_name", F.round("usd_value", 6).alias("usd_value"), "primary_token_id", "primary_asset_key", "primary_direction")


def s4_cursors(spark, d):
    rows = X.events(spark, d).select("wallet", "chain", F.col("event_id").alias("id"), F.col("k").alias("idx"), "ts")
    before = rows.where("idx % 3 = 0").groupBy("wallet", "chain").agg(F.min("ts").alias("cursor"))
    timed = rows.withColumn("ts", F.when(F.col("idx") % 8 == 0, 0).otherwise(F.col("ts")))
    return G.page_cursors(timed.unionByName(timed.where("idx % 3 = 0")), 1704100000, before)


def s5_coverage(spark, d):
    ev = X.events(spark, d)
    part = lambda cond: ev.where(cond).groupBy("entity_id", "wallet", "chain").agg(F.min("ts").alias("covered_from"), F.max("ts").alias("covered_to"), F.count("*").alias("pages"), F.when(F.max("k") > 95, "complete").otherwise("partial").alias("state"))
    return G.merge_coverage(part("k < 50"), part("k >= 50"))


def s6_uncovered(spark, d):
    wanted = X.events(spark, d).select("entity_id", "wallet", "chain").distinct().withColumn("from_ts", F.lit(1704300000).cast("long")).withColumn("to_ts", F.lit(1706400000).cast("long"))
    return G.uncovered(wanted, _ledger(spark, d))


def s7_insert_new(spark, d):
    ev = X.events(spark, d).select(F.concat("wallet", F.col("k") % 10).alias("event_id"), "ts", "k")
    return G.insert_new(ev.where("k < 20"), ev.where("k >= 20"), "event_id", [F.asc("ts"), F.asc("k")]).select("event_id", "ts", "k")


def s8_asset_symbols(spark, d):
    tokens = X.legs(spark, d).join(X.order_events(spark, d).select("event_id", "chain"), "event_id").select("chain", "token_id", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("S"), "event_id")).alias("symbol"), F.col("event_id").alias("name"), F.struct(F.col("event_id").cast("long"), "pos").alias("seq"))
    return G.asset_symbols(tokens)


def s9_membership(spark, d):
    return G.membership(_memberships(spark, d))


def s10_address_family(spark, d):
    tail = F.rpad("event_id", 40, "0")
    address = F.when(F.col("k") % 4 == 0, F.concat(F.lit("0x"), tail)).when(F.col("k") % 4 == 1, F.concat(F.lit("bc1"), "wallet")).when(F.col("k") % 4 == 2, F.concat(F.lit("3"), "wallet")).otherwise(F.concat(F.lit("0x"), "wallet"))
    return X.events(spark, d).groupBy("chain", N.address_family(address).alias("family")).agg(F.count("*").alias("n"))


def s11_discovery(spark, d):
    return G.discovery_summary(G.membership(_memberships(spark, d)))


def _snapshots(spark, d):
    ev = X.events(spark, d).select("entity_id", F.col("primary_asset_key").alias("kind"), F.lit("api").alias("source"), F.col("event_id").alias("payload"), F.struct("ts", "event_id").alias("captured_at"), "k")
    return G.append_snapshots(ev.where("k % 5 != 0"), ev.where("k % 5 = 0"))


def s12_snapshots(spark, d):
    return _snapshots(spark, d).groupBy("entity_id", "kind", "source").agg(F.count("*").alias("n"))


def s13_latest_snapshot(spark, d):
    return G.latest_snapshot(_snapshots(spark, d), ["entity_id", "kind", "source"]).select("entity_id", "kind", "source", "payload", F.col("captured_at.ts").alias("ts"))


def s14_missing_enrichment(spark, d):
    ev = X.events(spark, d).withColumn("tx_hash", F.concat(F.lit("tx"), F.col("event_id").cast("long") % 400))
    return G.missing_enrichment(ev, ev.where("k % 2 = 0").withColumn("source", F.when(F.col("k") % 4 == 0, "status").otherwise("trace")), ("status", "trace"))


def s15_surfaces(spark, d):
    raw = X.events(spark, d).select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("sig"), F.col("k"))).alias("signature"), F.when(F.col("k") % 3 == 1, F.concat(F.lit("tx"), "wallet")).alias("txHash"), F.when(F.col("k") % 6 == 2, F.concat(F.lit("id"), "wallet")).alias("id"), F.col("k"))
    return G.dedupe_surface(raw).select("surface_key")


def s16_derivatives(spark, d):
    ev = X.events(spark, d).select((F.floor(F.col("ts") / 3600)).alias("captured_at"), F.col("chain").alias("source"), F.col("primary_asset_key").alias("instrument"), F.concat(F.lit("kind"), F.col("k") % 2).alias("kind"))
    return G.append_market_snapshot(ev.where("source != 'op'"), ev.where("kind = 'kind1'"))


def s17_enrolled(spark, d):
    return G.enroll(X.events(spark, d), _runs(spark, d))


def s18_entities(spark, d):
    return G.entity_dim(X.events(spark, d).select("entity_id").distinct().select(F.col("entity_id").alias("id"), F.when(F.col("entity_id") != "ent_2", F.upper("entity_id")).alias("name")))


def s19_report(spark, d):
    from tracewright.operators.backtest import write_report

    path = scratch(spark, "report")
    write_report(X.events(spark, d).groupBy("wallet").agg(F.count("*").alias("n"), F.when(F.max("k") > 95, F.round(F.min("usd_value"), 2)).alias("qvalue")), path)
    return spark.read.schema("wallet string, n long, qvalue double").option("header", True).csv(path)


def s20_evolution(spark, d):
    old = X.events(spark, d).select("event_id", "wallet")
    return G.conform(old, {"event_id": ("string", None), "wallet": ("string", "none"), "built": ("boolean", False), "attempts": ("int", 0)})


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] in "qs" and name[1:2].isdigit()}

_RUNS = f"rn AS (SELECT entity_id, CAST(floor(min(ts) / {DAY}) * {DAY} AS BIGINT) AS from_ts, CAST(floor((min(ts) + {9 * DAY}) / {DAY}) * {DAY} AS BIGINT) AS to_day_ts, 'run_' || entity_id AS run_id FROM ev GROUP BY 1)"
_ENROLLED = "enr AS (SELECT run_id, event_id FROM ev JOIN rn USING (entity_id) WHERE ts >= from_ts AND ts <= to_day_ts + 86399)"
_KINDS = "sn AS (SELECT entity_id, primary_asset_key AS kind, CASE WHEN k % 5 = 0 THEN 'error' ELSE 'api' END AS source, event_id AS payload, ts FROM ev)"
_TOKEN_KEY = "CASE " + " ".join(f"WHEN chain = '{c}' AND lower(token_id) LIKE '0x%' THEN '{v}:' || lower(token_id)" for c, v in N.PRICE_CHAINS.items()) + " END"
#: Rows of the pages: those with a time; what the first leg worth most is, if any is worth something.
_PAGE_ROWS = f"""{EV}, pr AS (SELECT * EXCLUDE (cate_id), CASE WHEN k % 5 <> 0 THEN event_id END AS id, coalesce(CASE WHEN k % 5 <> 0 THEN event_id END, 'tx' || event_id) AS tx_hash, CASE WHEN k % 4 < 2 THEN 'CATE' || (k % 4) END AS cate_name,
  CASE k % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'OUT' ELSE 'BIDIRECTIONAL' END AS side, CASE WHEN k * usd_value <> 0 THEN CASE WHEN k % 3 = 0 THEN 'eth' ELSE '0xToken' END END AS token FROM ev WHERE k % 8 <> 0)"""

ORACLES = {
    "q1_explorer": f"WITH {_AG} SELECT pattern_key, pattern, n FROM g WHERE n BETWEEN 4 AND 400 AND entity_id = 'ent_1' AND horizon_seconds = {DAY} AND starts_with(pattern, 'BIGRAM:') AND asset_key = 'asset:purchase' ORDER BY n DESC, pattern_key LIMIT 100",
    "q2_rank": f"WITH {_AG} SELECT pattern_key, n, round({_SCORE}, 4) AS score FROM g WHERE n >= 3 ORDER BY {_SCORE} DESC, n DESC, pattern_key LIMIT 50",
    "q3_orders": f"WITH {_AG} SELECT pattern_key, n, negative_count, positive_count FROM g WHERE n >= 3 ORDER BY greatest(negative_count, positive_count) / n DESC, n DESC, pattern_key LIMIT 40 OFFSET 10",
    "q4_dashboard": f"WITH {_AG} SELECT pattern_key, n, ['EARLY', 'PROMISING', 'ESTABLISHING', 'ROBUST'][stage + 1] AS maturity FROM g WHERE n >= 3 ORDER BY stage DESC, n DESC, abs(mean_return) DESC, pattern_key LIMIT 24",
    "q5_display": f"""WITH {_AG} SELECT pattern_key, round(negative_count / n, 6) AS negative_rate, round(positive_count / n, 6) AS positive_rate, CASE WHEN mean_return > 0 THEN 'up' WHEN mean_return < 0 THEN 'down' ELSE 'flat' END AS direction,
      CASE WHEN asset_key = 'asset:purchase' THEN 'purchase' ELSE upper(substr(asset_key, 7, 3)) END AS asset_label, 'asset' AS asset_chain FROM g""",
    "q6_observations": f"WITH {T._NEW} SELECT observation_key, start_ts AS episode_ts, round(r, 6) AS return_value FROM nw WHERE pattern = 'ACTION:CONTRACT_INTERACTION' ORDER BY start_ts DESC, observation_key DESC LIMIT 200",
    "q7_horizon_profile": f"WITH {T._NEW} SELECT entity_id, pattern, horizon_seconds, count(*) AS n, round(avg(r), 6) AS mean_return FROM nw GROUP BY 1, 2, 3",
    "q8_histogram": f"""WITH {EV}, b AS (SELECT entity_id, primary_asset_key, min(usd_value) AS lo, max(usd_value) AS hi FROM ev GROUP BY 1, 2), w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 12 ELSE 1.0 END AS w FROM b),
      p AS (SELECT entity_id, primary_asset_key, lo, w, CAST(least(11, floor((usd_value - lo) / w)) AS INT) AS bin FROM ev JOIN w USING (entity_id, primary_asset_key))
      SELECT entity_id, primary_asset_key, bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, count(*) AS n FROM p GROUP BY entity_id, primary_asset_key, bin, lo, w""",
    "q9_checkpoint_series": f"WITH {T._AGG}, m AS (SELECT unnest([10, 25, 50]) AS mark) SELECT pattern_key, mark AS n, CASE WHEN mark < 20 THEN 'EARLY' ELSE 'PROMISING' END AS maturity FROM ag JOIN m ON n >= mark",
    "q10_evidence": f"WITH {T.DAYS} SELECT episode_id, motif, array_to_string(patterns, ';') AS patterns FROM epd WHERE entity_id IN ('ent_0', 'ent_3') AND start_ts BETWEEN 1704300000 AND 1705000000",
    "q11_quality": f"""WITH {_STATE}, {_LEDGER}, {_LOG}, a AS (SELECT entity_id, count(*) AS n_episodes, count(*) FILTER (asset_key IS NULL) AS n_no_asset, count(*) FILTER (k % 5 = 4) AS n_unclassified, count(*) FILTER (k % 5 = 0) AS n_unknown, round(avg(CASE WHEN k % 5 < 4 THEN k / 100 END), 6) AS mean_confidence FROM ep GROUP BY 1),
      h AS (SELECT ep.entity_id, count(*) FILTER (s0 = 'pending') AS n_pending, count(*) FILTER (s0 = 'permanently unavailable') AS n_unavailable FROM st JOIN ep USING (episode_id) GROUP BY 1),
      c AS (SELECT entity_id, count(*) FILTER (state = 'complete') AS n_complete, max(covered_to) - min(covered_from) AS covered_s FROM led GROUP BY 1), r AS (SELECT entity_id, round(avg(CASE WHEN status < 400 THEN 1.0 ELSE 0 END), 6) AS request_success FROM log GROUP BY 1)
      SELECT * FROM a JOIN h USING (entity_id) JOIN c USING (entity_id) JOIN r USING (entity_id)""",
    "q12_counters": f"""WITH {T.DAYS}, e AS (SELECT entity_id, count(*) AS n_events FROM ev GROUP BY 1), p AS (SELECT entity_id, count(*) AS n_episodes, count(intent_label) AS n_classified FROM epd GROUP BY 1), o AS (SELECT entity_id, count(*) AS n_usable FROM obs GROUP BY 1)
      SELECT entity_id, n_events, n_episodes, n_classified, n_episodes * {len(HORIZONS)} AS n_labels, n_usable FROM e JOIN p USING (entity_id) JOIN o USING (entity_id)""",
    "q13_backlog": f"""WITH {T._DUE}, l AS (SELECT count(*) AS c FROM epd CROSS JOIN (SELECT unnest({list(HORIZONS)}) AS h) WHERE start_ts + h > {NOW}),
      f AS (SELECT count(*) AS c FROM epd CROSS JOIN (SELECT unnest({list(HORIZONS)}) AS h) x WHERE start_ts + h <= {NOW} AND NOT EXISTS (SELECT 1 FROM labd WHERE labd.episode_id = epd.episode_id AND labd.horizon_seconds = x.h))
      SELECT 'unbuilt' AS stage, count(*) AS n FROM ev WHERE k % 9 = 0 UNION ALL SELECT 'unclassified', count(*) FROM epd WHERE intent_label IS NULL UNION ALL SELECT 'pending', (SELECT c FROM l) + (SELECT c FROM f)
      UNION ALL SELECT 'unobserved', count(*) FROM obs WHERE horizon_seconds > 3600 UNION ALL SELECT 'due', count(*) FROM du""",
    "q14_progress": f"WITH {EV} SELECT entity_id, round(least(0.95, 0.05 + 0.45 * avg(CASE WHEN k < 80 THEN 1.0 ELSE 0 END) + 0.1 * (least(1, avg(CASE WHEN k < 50 THEN 1.0 ELSE 0 END)) + least(1, avg(k / 40)))), 6) AS progress FROM ev GROUP BY 1",
    "q15_top_tokens": f"""WITH {ORD}, {LEGS}, t AS (SELECT wallet, chain, token_id, round(sum(abs(amount * price)), 4) AS usd, min((ts, event_id, pos)) AS f FROM legs JOIN ord USING (event_id) GROUP BY 1, 2, 3)
      SELECT wallet, chain, token_id, usd FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY usd DESC, f) AS r FROM t) WHERE r <= 3""",
    "q16_entity_cap": f"WITH {EV} SELECT entity_id, event_id, usd_value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY usd_value DESC, event_id) AS r FROM ev) WHERE r <= 7",
    "q17_provenance": f"WITH {EV}, {_MEMBERS} SELECT entity_id, address, min(chain) AS chain, count(DISTINCT (chain, source)) AS n_sources FROM mem GROUP BY 1, 2",
    "q18_latest": f"WITH {EV} SELECT event_id, ts FROM ev WHERE action_type = 'CONTRACT_INTERACTION' ORDER BY ts DESC, event_id DESC LIMIT 30",
    "q19_runs": f"WITH {EV}, {_RUNS}, {_ENROLLED} SELECT run_id, entity_id, count(event_id) AS n_events FROM rn LEFT JOIN enr USING (run_id) GROUP BY 1, 2",
    "q20_requests": f"WITH {EV}, {_LOG} SELECT endpoint, count(*) AS n, count(*) FILTER (status >= 400) AS n_failed, max(seconds) AS slowest FROM log GROUP BY 1",
    "s1_archive": f"""WITH {EV}, p AS (SELECT '{{"w":"' || wallet || '","k":' || (k % 7) || '}}' AS payload, min((action_type, CAST(floor(ts / {DAY}) AS BIGINT))) AS v FROM ev GROUP BY 1), u AS (SELECT payload, struct_extract(v, 1) AS provider, struct_extract(v, 2) AS day FROM p)
      SELECT provider, day, payload, sha256(payload) AS sha256 FROM u""",
    "s2_latest_valid": f"WITH {EV}, {_LOG} SELECT endpoint, request, response_id FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, request ORDER BY fetched_at DESC, response_id DESC) AS r FROM log) WHERE r = 1 AND status < 400 AND (1706000000 - fetched_at < 3600 OR cursor > 0)",
    "s3_history_flatten": f"WITH {_PAGE_ROWS} SELECT wallet, id, k AS idx, ts, cate_name, upper(cex_id) AS cex_name, upper(project_id) AS project_name FROM pr",
    "s3_normalized_events": f"""WITH {_PAGE_ROWS} SELECT sha256('["' || entity_id || '","' || wallet || '","' || chain || '","' || tx_hash || '",' || k || ',' || ts || ']') AS event_id, wallet, chain, tx_hash, k AS event_index, ts,
      CASE WHEN k % 17 = 0 THEN 'APPROVAL' WHEN cex_id IS NOT NULL THEN 'CEX_INTERACTION_' || side WHEN project_id IS NOT NULL THEN 'DEFI_INTERACTION_' || side WHEN side = 'BIDIRECTIONAL' THEN 'ASSET_EXCHANGE_LIKE' ELSE 'TRANSFER_' || side END AS action_type,
      cate_name, upper(cex_id) AS cex_name, upper(project_id) AS project_name, round(abs(k * usd_value), 6) AS usd_value, token AS primary_token_id,
      CASE token WHEN '0xToken' THEN CASE chain WHEN 'eth' THEN 'ethereum' WHEN 'arb' THEN 'arbitrum' WHEN 'op' THEN 'optimism' ELSE chain END || ':0xtoken' WHEN 'eth' THEN CASE WHEN chain <> 'bsc' THEN 'coingecko:ethereum' END END AS primary_asset_key,
      CASE token WHEN '0xToken' THEN 'send' WHEN 'eth' THEN 'receive' END AS primary_direction FROM pr""",
    "s4_cursors": f"""WITH {EV}, p AS (SELECT wallet, chain, count(*) AS n_rows, coalesce(min(ts) FILTER (WHERE k % 8 <> 0), 0) AS oldest, coalesce(min(ts) FILTER (WHERE k % 3 = 0), 0) AS last FROM ev GROUP BY 1, 2)
      SELECT wallet, chain, n_rows, CASE WHEN oldest > 0 THEN oldest ELSE last END AS cursor,
        oldest = 0 OR (last > 0 AND oldest >= last) OR oldest <= 1704100000 AS complete FROM p""",
    "s5_coverage": f"""WITH {EV} SELECT entity_id, wallet, chain, min(ts) AS covered_from, max(ts) AS covered_to, count(*) AS pages, CASE WHEN max(k) > 95 THEN 'complete' ELSE 'partial' END AS state FROM ev GROUP BY 1, 2, 3""",
    "s6_uncovered": f"WITH {EV}, {_LEDGER} SELECT entity_id, wallet, chain, CAST(1704300000 AS BIGINT) AS from_ts, CAST(1706400000 AS BIGINT) AS to_ts FROM led WHERE NOT (state = 'complete' AND covered_from <= 1704300000 AND covered_to >= 1706400000)",
    "s7_insert_new": f"WITH {EV}, a AS (SELECT wallet || (k % 10) AS event_id, ts, k FROM ev) SELECT event_id, ts, k FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, k) AS r FROM a WHERE k >= 20) WHERE r = 1 AND event_id NOT IN (SELECT event_id FROM a WHERE k < 20)",
    "s8_asset_symbols": f"""WITH {ORD}, {LEGS}, t AS (SELECT {_TOKEN_KEY} AS asset_key, 'S' || event_id AS symbol, event_id AS name, row_number() OVER (PARTITION BY {_TOKEN_KEY} ORDER BY CAST(event_id AS BIGINT) DESC, pos DESC) AS r FROM legs JOIN ord USING (event_id) WHERE pos % 2 = 0)
      SELECT asset_key, symbol, name FROM t WHERE r = 1 AND asset_key IS NOT NULL""",
    "s9_membership": f"WITH {EV}, {_MEMBERS} SELECT entity_id, address, chain, source, max(confidence) AS confidence, arg_max(event_id, (ts, event_id)) AS meta FROM mem GROUP BY 1, 2, 3, 4",
    "s10_address_family": f"WITH {EV} SELECT chain, CASE k % 4 WHEN 0 THEN 'evm' WHEN 3 THEN 'solana' ELSE 'bitcoin' END AS family, count(*) AS n FROM ev GROUP BY 1, 2",
    "s11_discovery": f"WITH {EV}, {_MEMBERS} SELECT entity_id, source, count(DISTINCT address) AS n_addresses, count(DISTINCT chain) AS n_chains FROM mem GROUP BY 1, 2",
    "s12_snapshots": f"WITH {EV}, {_KINDS} SELECT entity_id, kind, source, count(*) AS n FROM sn GROUP BY 1, 2, 3",
    "s13_latest_snapshot": f"WITH {EV}, {_KINDS} SELECT entity_id, kind, source, arg_max(payload, (ts, payload)) AS payload, max(ts) AS ts FROM sn GROUP BY 1, 2, 3",
    "s14_missing_enrichment": f"""WITH {EV}, t AS (SELECT 'tx' || (CAST(event_id AS BIGINT) % 400) AS tx_hash, chain, k FROM ev), w AS (SELECT DISTINCT tx_hash, chain, unnest(['status', 'trace']) AS source FROM t)
      SELECT tx_hash, chain, source FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.tx_hash = w.tx_hash AND t.chain = w.chain AND k % 4 = CASE source WHEN 'status' THEN 0 ELSE 2 END)""",
    "s15_surfaces": f"WITH {EV} SELECT DISTINCT CASE WHEN k % 3 = 0 THEN 'sig' || k WHEN k % 3 = 1 THEN 'tx' || wallet WHEN k % 6 = 2 THEN 'id' || wallet ELSE 'null|' || k || '|null|null' END AS surface_key FROM ev",
    "s16_derivatives": f"WITH {EV} SELECT DISTINCT CAST(floor(ts / 3600) AS BIGINT) AS captured_at, chain AS source, primary_asset_key AS instrument, 'kind' || (k % 2) AS kind FROM ev WHERE chain <> 'op' OR k % 2 = 1",
    "s17_enrolled": f"WITH {EV}, {_RUNS}, {_ENROLLED} SELECT run_id, event_id FROM enr",
    "s18_entities": f"WITH {EV} SELECT DISTINCT entity_id AS id, CASE WHEN entity_id = 'ent_2' THEN entity_id ELSE upper(entity_id) END AS name FROM ev",
    "s19_report": f"WITH {EV} SELECT wallet, count(*) AS n, CASE WHEN max(k) > 95 THEN round(min(usd_value), 2) END AS qvalue FROM ev GROUP BY 1",
    "s20_evolution": f"WITH {EV} SELECT event_id, wallet, false AS built, CAST(0 AS INT) AS attempts FROM ev",
}
