"""Registered queries on intent classification, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import normalize as N
from tracewright.operators import intent as I
from tracewright.plans.behaviour import _MAPPED, _NATIVE
from tracewright.sources import fixtures as X
from tracewright.sources.fixtures import EV, LEGS, ORD


def _parts(spark, d):
    """Orders as one-event episodes, their legs, and every nation's accounts."""
    legs = X.legs(spark, d)
    sides = legs.groupBy("event_id").agg(F.bool_or(F.col("side") == "send").alias("s"), F.bool_or(F.col("side") == "receive").alias("r"))
    events = X.order_events(spark, d).join(sides, "event_id", "left").fillna(False, ["s", "r"])
    events = events.withColumn("action_type", N.action_class(F.lit(None).cast("string"), F.col("cex_id"), F.col("project_id"), F.col("s"), F.col("r"))).withColumn("episode_id", F.col("event_id"))
    owned = X.table(spark, d, "customer").select(F.concat(F.lit("nation_"), "c_nationkey").alias("entity_id"), F.concat(F.lit("c"), "c_custkey").alias("address"))
    return events, legs, owned


def _features(spark, d):
    return I.intent_features(*_parts(spark, d))


PARTS = f"""{ORD}, {LEGS}, sd AS (SELECT event_id, bool_or(side = 'send') AS s, bool_or(side = 'receive') AS r FROM legs GROUP BY 1),
  ep AS (SELECT *, CASE WHEN cex_id IS NOT NULL THEN 'CEX_INTERACTION' || side WHEN project_id IS NOT NULL THEN 'DEFI_INTERACTION' || side WHEN s AND r THEN 'ASSET_EXCHANGE_LIKE' WHEN s THEN 'TRANSFER_OUT' WHEN r THEN 'TRANSFER_IN' ELSE 'CONTRACT_INTERACTION' END AS action_type
    FROM (SELECT *, CASE WHEN s AND r THEN '_BIDIRECTIONAL' WHEN s THEN '_OUT' WHEN r THEN '_IN' ELSE '' END AS side FROM (SELECT ord.*, coalesce(s, false) AS s, coalesce(r, false) AS r FROM ord LEFT JOIN sd USING (event_id)))),
  own AS (SELECT DISTINCT 'nation_' || c_nationkey AS entity_id, 'c' || c_custkey AS address FROM customer),
  fl AS (SELECT event_id, side, coalesce(CASE {_NATIVE} {_MAPPED} END, lower(token)) AS asset, value, stable, addr, known, known AND addr <> wallet AS owned FROM (
    SELECT l.event_id, l.side, l.token_id AS token, o.chain, o.wallet, l.addr, CASE WHEN l.amount * l.price <> 0 THEN abs(l.amount * l.price) ELSE 1.0 END AS value, l.token_id = 'usdc' AS stable, x.address IS NOT NULL AS known
    FROM legs l JOIN ord o USING (event_id) LEFT JOIN own x ON x.entity_id = o.entity_id AND x.address = l.addr)),
  sm AS (SELECT event_id, round(sum(CASE WHEN side = 'send' AND stable THEN value ELSE 0 END), 6) AS so, round(sum(CASE WHEN side = 'receive' AND stable THEN value ELSE 0 END), 6) AS si,
    round(sum(CASE WHEN side = 'send' AND NOT stable THEN value ELSE 0 END), 6) AS ro, round(sum(CASE WHEN side = 'receive' AND NOT stable THEN value ELSE 0 END), 6) AS ri,
    count(*) FILTER (coalesce(owned, false)) AS n_own, count(*) FILTER (side = 'send' AND NOT coalesce(owned, false)) AS xo, count(*) FILTER (side = 'receive' AND NOT coalesce(owned, false)) AS xi,
    count(DISTINCT addr) FILTER (side = 'send' AND NOT known) AS rc, list_sort(list(DISTINCT asset) FILTER (side = 'send')) AS sa, list_sort(list(DISTINCT asset) FILTER (side = 'receive')) AS ra FROM fl GROUP BY 1),
  ft AS (SELECT ep.event_id AS episode_id, action_type, coalesce(so, 0) AS so, coalesce(si, 0) AS si, coalesce(ro, 0) AS ro, coalesce(ri, 0) AS ri, coalesce(n_own, 0) AS n_own, coalesce(xo, 0) AS xo, coalesce(xi, 0) AS xi, coalesce(rc, 0) AS rc,
    coalesce(sa, []) = coalesce(ra, []) AS same, coalesce(project_id, '') LIKE '%bridge%' AS bridge, coalesce(project_id, '') LIKE '%liquidity%' AS liquidity FROM ep LEFT JOIN sm USING (event_id))"""

SCORES = f"""{PARTS}, sc AS (SELECT episode_id, unnest([
    struct_pack(label := 'bridge_reposition', s := CASE WHEN bridge THEN 8.0 ELSE 0 END), struct_pack(label := 'liquidity_management', s := CASE WHEN liquidity THEN 7.0 ELSE 0 END),
    struct_pack(label := 'internal_rebalance', s := CASE WHEN n_own = 0 THEN 0 WHEN n_own >= xo + xi THEN 8.0 ELSE 4.0 END), struct_pack(label := 'buy', s := CASE WHEN so > 0 AND ri > 0 THEN 6.0 ELSE 0 END),
    struct_pack(label := 'sell', s := CASE WHEN ro > 0 AND si > 0 THEN 6.0 ELSE 0 END + CASE WHEN action_type = 'CEX_INTERACTION_OUT' AND ro > 0 AND ri = 0 THEN 4.5 ELSE 0 END),
    struct_pack(label := 'asset_rotation', s := CASE WHEN ro > 0 AND ri > 0 AND so = 0 AND si = 0 AND NOT same THEN 6.0 ELSE 0 END),
    struct_pack(label := 'accumulation', s := CASE WHEN action_type = 'CEX_INTERACTION_IN' AND ri > 0 AND ro = 0 THEN 4.5 ELSE 0 END + CASE WHEN ri > 0 AND ro = 0 AND so = 0 AND xi > 0 THEN 3.0 ELSE 0 END),
    struct_pack(label := 'distribution', s := CASE WHEN ro > 0 AND ri = 0 AND si = 0 AND xo > 0 THEN CASE WHEN rc >= 2 THEN 4.5 ELSE 2.0 END ELSE 0 END),
    struct_pack(label := 'inventory_rebalance', s := CASE WHEN (action_type LIKE '%BIDIRECTIONAL%' OR action_type LIKE '%EXCHANGE_LIKE%') AND NOT bridge AND NOT liquidity THEN 3.0 ELSE 0 END + CASE WHEN ri > 0 AND ro > 0 AND same THEN 4.0 ELSE 0 END)]) AS x FROM ft),
  rk AS (SELECT episode_id, x.label AS label, CAST(x.s AS DOUBLE) AS s, row_number() OVER (PARTITION BY episode_id ORDER BY x.s DESC, x.label) AS r FROM sc WHERE x.s > 0),
  tp AS (SELECT f.episode_id, coalesce(max(CASE WHEN r = 1 THEN s END), 0) AS top, coalesce(max(CASE WHEN r = 2 THEN s END), 0) AS second, max(CASE WHEN r = 1 THEN label END) AS best, count(r) AS n FROM ft f LEFT JOIN rk USING (episode_id) GROUP BY 1),
  lb AS (SELECT episode_id, CASE WHEN top < 3 OR (second >= 3 AND top - second < 1.5) THEN 'unknown' ELSE best END AS intent_label,
    CASE WHEN n = 0 THEN 0.8 WHEN top < 3 OR (second >= 3 AND top - second < 1.5) THEN 0.45 ELSE least(0.99, 0.62 + 0.045 * top + 0.035 * least(top - second, 4)) END AS confidence FROM tp)"""


def c1_stable_legs(spark, d):
    legs = X.legs(spark, d).withColumn("symbol", F.when(F.col("pos") % 4 == 0, "FRAX"))
    return legs.select("event_id", "pos", I.is_stable(F.col("token_id"), F.col("symbol")).alias("stable"))


def c2_leg_value(spark, d):
    price = F.when(F.col("pos") % 3 == 0, 0.0).when(F.col("pos") % 3 == 1, F.col("price"))
    return X.legs(spark, d).groupBy("event_id").agg(F.round(F.sum(I.leg_value(F.col("amount"), price)), 4).alias("value"))


def c3_flow_features(spark, d):
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias(c)
    return _features(spark, d).select("episode_id", "stable_sent", "stable_received", "risk_sent", "risk_received", "event_count", *map(text, ("action_counts", "project_counts", "cate_counts", "cex_counts")))


def c4_own_external(spark, d):
    return _features(spark, d).select("episode_id", "own_count", "external_out", "external_in")


def c5_recipients(spark, d):
    return _features(spark, d).groupBy("recipients").agg(F.count("*").alias("n"))


def c6_markers(spark, d):
    return _features(spark, d).select("episode_id", "bridge", "liquidity")


def _enrichments(spark, d):
    ev = X.events(spark, d)
    text = F.element_at(F.array(*map(F.lit, ("Bridge COMPLETED", "stargate failed", "error: filled via hop protocol", "error at bridge", "done", "ok"))), F.col("k") % 6 + 1)
    source = F.when(F.col("k") % 4 == 0, "lifi_status").otherwise("trace")
    return ev.select("event_id", "k", source.alias("source"), text.alias("payload"))


def c7_bridge_success(spark, d):
    return _enrichments(spark, d).select("event_id", "source", I.bridge_success(F.col("source"), F.col("payload")).alias("done"))


def c8_target_flow(spark, d):
    target = F.lit("ethereum:0x0007")
    return _features(spark, d).select("episode_id", I.target_flow(target, F.col("send_assets")).alias("sent"), I.target_flow(target, F.col("receive_assets")).alias("received")).where("sent > 0 or received > 0")


def c9_pre_event_profile(spark, d):
    return I.pre_event_profile(X.events(spark, d))


def c9_pre_event_counts(spark, d):
    return I.pre_event_counts(X.events(spark, d), "action_type").groupBy("event_id").agg(F.count("*").alias("n_actions"), F.sum("prior_n").alias("prior_n"))


def c10_scores(spark, d):
    return I.classify(_features(spark, d)).select("episode_id", F.explode("scores").alias("label", "score"))


def c11_intent(spark, d):
    return I.classify(_features(spark, d)).select("episode_id", "intent_label", F.round("confidence", 3).alias("confidence"))


def c12_reasons(spark, d):
    return I.classify(_features(spark, d)).groupBy("intent_label", F.size("scores").alias("n_scores"), F.size("reasons").alias("n_reasons")).agg(F.count("*").alias("n"))


def c13_unclassified(spark, d):
    ep = X.events(spark, d).select(F.col("event_id").alias("episode_id"), F.col("ts").alias("start_ts"), F.when(F.col("k") % 3 == 0, "buy").alias("intent_label"))
    return I.unclassified(ep, from_ts=1704500000, to_ts=1706000000, limit=500).select("episode_id", "start_ts")


def c14_label_summary(spark, d):
    events, _, _ = _parts(spark, d)
    return I.label_summary(I.classify(_features(spark, d)).join(events.select("episode_id", "entity_id"), "episode_id").withColumn("confidence", F.round("confidence", 3)))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "c" and name[1:2].isdigit()}

ORACLES = {
    "c1_stable_legs": f"WITH {LEGS} SELECT event_id, CAST(pos AS INT) AS pos, token_id = 'usdc' OR pos % 4 = 0 AS stable FROM legs",
    "c2_leg_value": f"WITH {LEGS} SELECT event_id, round(sum(CASE WHEN pos % 3 = 1 AND amount * price <> 0 THEN abs(amount * price) ELSE 1 END), 4) AS value FROM legs GROUP BY 1",
    "c3_flow_features": f"WITH {PARTS} SELECT episode_id, so AS stable_sent, si AS stable_received, ro AS risk_sent, ri AS risk_received, 1 AS event_count, ft.action_type || '=1' AS action_counts, coalesce(project_id || '=1', '') AS project_counts, coalesce(cate_id || '=1', '') AS cate_counts, coalesce(cex_id || '=1', '') AS cex_counts FROM ft JOIN ep ON event_id = episode_id",
    "c4_own_external": f"WITH {PARTS} SELECT episode_id, n_own AS own_count, xo AS external_out, xi AS external_in FROM ft",
    "c5_recipients": f"WITH {PARTS} SELECT rc AS recipients, count(*) AS n FROM ft GROUP BY 1",
    "c6_markers": f"WITH {PARTS} SELECT episode_id, bridge, liquidity FROM ft",
    "c7_bridge_success": f"""WITH {EV} SELECT event_id, CASE WHEN k % 4 = 0 THEN 'lifi_status' ELSE 'trace' END AS source, k % 6 IN (0, 2) OR (k % 6 = 4 AND k % 4 = 0) AS done FROM ev""",
    "c8_target_flow": f"""WITH {PARTS} SELECT event_id AS episode_id, round(sum(CASE WHEN side = 'send' THEN value ELSE 0 END), 6) AS sent, round(sum(CASE WHEN side = 'receive' THEN value ELSE 0 END), 6) AS received
      FROM fl WHERE asset = 'ethereum:0x0007' GROUP BY 1""",
    "c9_pre_event_profile": f"""WITH {EV} SELECT event_id, count(*) OVER w AS prior_n, round(coalesce(sum(usd_value) OVER w, 0), 4) AS prior_usd FROM ev WINDOW w AS (PARTITION BY wallet ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "c9_pre_event_counts": f"""WITH {EV} SELECT e.event_id, count(DISTINCT p.action_type) AS n_actions, count(*) AS prior_n FROM ev e JOIN ev p ON p.wallet = e.wallet AND p.ts < e.ts GROUP BY 1""",
    "c10_scores": f"WITH {SCORES} SELECT episode_id, label, s AS score FROM rk",
    "c11_intent": f"WITH {SCORES} SELECT episode_id, intent_label, round(confidence, 3) AS confidence FROM lb",
    "c12_reasons": f"""WITH {SCORES} SELECT intent_label, CAST(n AS INT) AS n_scores, CAST(CASE WHEN n = 0 THEN 1 WHEN intent_label = 'unknown' THEN least(n, 3) ELSE 1 END AS INT) AS n_reasons, count(*) AS n FROM lb JOIN tp USING (episode_id) GROUP BY 1, 2, 3""",
    "c13_unclassified": f"WITH {EV} SELECT event_id AS episode_id, ts AS start_ts FROM ev WHERE k % 3 <> 0 AND ts BETWEEN 1704500000 AND 1706000000 ORDER BY ts, event_id LIMIT 500",
    "c14_label_summary": f"""WITH {SCORES} SELECT entity_id, count(*) AS n, count(*) FILTER (intent_label = 'unknown') AS n_unknown, count(intent_label) AS n_labelled, round(avg(round(confidence, 3)), 6) AS mean_confidence
      FROM lb JOIN ord ON ord.event_id = lb.episode_id GROUP BY 1""",
}
