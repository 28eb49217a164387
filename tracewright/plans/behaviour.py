"""Registered queries on normalization, windows, links and episodes, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import normalize as N
from tracewright.functions import patterns as P
from tracewright.operators import asof, episodes, windows
from tracewright.sources import fixtures as X
from tracewright.sources.fixtures import EV, LEGS, ORD, SNAP

GAP, DAY = 21600, 86400
CONTEXTS = ("history", "flow", "volume")

TOKEN = "action_type || CASE WHEN coalesce(cex_id, '') <> '' THEN '@cex:' || cex_id WHEN coalesce(project_id, '') <> '' THEN '@project:' || project_id WHEN coalesce(cate_id, '') <> '' THEN '@cate:' || cate_id ELSE '' END"


def windows_sql(gap: int) -> str:
    """Common table expressions ev, anchors and win (ev with window_start)."""
    return f"""RECURSIVE {EV}, anchors(entity_id, wallet, anchor) AS (SELECT entity_id, wallet, min(ts) FROM ev GROUP BY ALL
      UNION ALL SELECT a.entity_id, a.wallet, min(e.ts) FROM anchors a JOIN ev e ON e.entity_id = a.entity_id AND e.wallet = a.wallet AND e.ts > a.anchor + {gap} GROUP BY a.entity_id, a.wallet, a.anchor),
      win AS (SELECT ev.*, a.anchor AS window_start FROM ev ASOF JOIN anchors a ON ev.entity_id = a.entity_id AND ev.wallet = a.wallet AND ev.ts >= a.anchor)"""


def links_sql(gap: int) -> str:
    return f"""tms AS (SELECT entity_id, wallet, ts, min(event_id) AS lo, max(event_id) AS hi FROM ev GROUP BY ALL),
      prb AS (SELECT e.* FROM ev e WHERE counterparty IS NOT NULL AND counterparty <> wallet AND EXISTS (SELECT 1 FROM ev x WHERE x.entity_id = e.entity_id AND x.wallet = e.counterparty)),
      fwd AS (SELECT p.event_id, r.lo AS id, r.ts - p.ts AS d FROM prb p ASOF JOIN tms r ON p.entity_id = r.entity_id AND p.counterparty = r.wallet AND p.ts <= r.ts),
      bwd AS (SELECT p.event_id, r.hi AS id, p.ts - r.ts AS d FROM prb p ASOF JOIN tms r ON p.entity_id = r.entity_id AND p.counterparty = r.wallet AND p.ts > r.ts),
      links AS (SELECT entity_id, event_id, linked_event_id FROM (SELECT p.entity_id, p.event_id, CASE WHEN f.d <= {gap} AND (b.d IS NULL OR b.d > {gap} OR f.d <= b.d) THEN f.id WHEN b.d <= {gap} THEN b.id END AS linked_event_id
        FROM prb p LEFT JOIN fwd f USING (event_id) LEFT JOIN bwd b USING (event_id)) WHERE linked_event_id IS NOT NULL)"""


COMPONENTS = """nod AS (SELECT *, entity_id || '|' || wallet || '|' || lpad(CAST(window_start AS VARCHAR), 12, '0') AS node FROM win),
      edg AS (SELECT DISTINCT a.node AS u, b.node AS v FROM links l JOIN nod a ON a.event_id = l.event_id JOIN nod b ON b.event_id = l.linked_event_id WHERE a.node <> b.node),
      sym AS (SELECT u, v FROM edg UNION SELECT v, u FROM edg), rch(node, peer) AS (SELECT u, u FROM sym UNION SELECT r.node, s.v FROM rch r JOIN sym s ON s.u = r.peer),
      cmp AS (SELECT node, min(peer) AS component FROM rch GROUP BY node), plc AS (SELECT nod.*, coalesce(component, node) AS component FROM nod LEFT JOIN cmp USING (node))"""


def episodes_sql(gap: int, size: int = 50) -> str:
    return f"""{windows_sql(gap)}, {links_sql(gap)}, {COMPONENTS},
      chk AS (SELECT *, {TOKEN} AS token, (row_number() OVER (PARTITION BY entity_id, component ORDER BY ts, event_id) - 1) // {size} AS chunk FROM plc),
      chn AS (SELECT entity_id, component, chunk, arg_min(chain, (-n, f)) AS chain FROM (SELECT entity_id, component, chunk, chain, count(*) AS n, min((ts, event_id)) AS f FROM chk GROUP BY ALL) GROUP BY ALL),
      ast AS (SELECT entity_id, component, chunk, arg_min(a, (-w, f)) AS primary_asset_key FROM (SELECT entity_id, component, chunk, primary_asset_key AS a,
        round(sum(CASE WHEN coalesce(usd_value, 0) = 0 THEN 1 ELSE usd_value END), 6) AS w, min((ts, event_id)) AS f FROM chk WHERE primary_asset_key IS NOT NULL GROUP BY ALL) GROUP BY ALL),
      eps AS (SELECT sha256('["' || entity_id || '",[' || string_agg('"' || event_id || '"', ',' ORDER BY ts, event_id) || ']]') AS episode_id, entity_id, component, chunk, min(ts) AS start_ts, max(ts) AS end_ts,
        list_sort(list(DISTINCT wallet)) AS wallets, list(event_id ORDER BY ts, event_id) AS event_ids, string_agg(token, '>' ORDER BY ts, event_id) AS motif, list(token ORDER BY ts, event_id) AS tokens,
        round(sum(usd_value), 6) AS gross_usd, count(*) AS n_events FROM chk GROUP BY entity_id, component, chunk)"""


def patterns_sql(tokens: str) -> str:
    """The pattern list of a list of tokens."""
    run = lambda n, name: f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: '{name}:' || array_to_string({tokens}[i:i + {n - 1}], '>'))"
    return f"""list_sort(list_distinct(list_concat({run(1, "ACTION")}, {run(2, "BIGRAM")}, {run(3, "TRIGRAM")},
      CASE WHEN len({tokens}) > 2 THEN ['ENDPOINT:' || {tokens}[1] || '>' || {tokens}[-1]] ELSE [] END, CASE WHEN len({tokens}) BETWEEN 4 AND 6 THEN ['FULL:' || array_to_string({tokens}, '>')] ELSE [] END)))"""


def _windows(spark, d, gap):
    return windows.anchored_windows(X.events(spark, d), ["entity_id", "wallet"], gap)


def e1_anchored_windows(spark, d):
    return _windows(spark, d, DAY).groupBy("entity_id", "wallet", "window_start").agg(F.count("*").alias("n"), F.max("ts").alias("end_ts"))


def _sequences(spark, d):
    token = N.action_token(F.col("action_type"), F.col("cex_id"), F.col("project_id"), F.col("cate_id"))
    each = F.array_sort(F.collect_list(F.struct("ts", "event_id", token.alias("token"))))
    return _windows(spark, d, DAY).groupBy("entity_id", "wallet", "window_start").agg(each.alias("s")).select("entity_id", "wallet", "window_start", F.col("s.token").alias("tokens"))


SEQUENCES = f"{windows_sql(DAY)}, seq AS (SELECT entity_id, wallet, window_start, list({TOKEN} ORDER BY ts, event_id) AS tokens FROM win GROUP BY ALL)"


def e6_motif(spark, d):
    return _sequences(spark, d).select("entity_id", "wallet", "window_start", P.motif(F.col("tokens")).alias("motif"))


def e7_patterns(spark, d):
    return _sequences(spark, d).select("entity_id", "wallet", "window_start", F.explode(P.patterns(F.col("tokens"))).alias("pattern"))


def _order_legs(spark, d):
    return X.legs(spark, d).withColumn("usd", N.leg_usd(F.col("amount"), F.col("price")))


def n1_legs(spark, d):
    """Legs regrouped per event, sends first, each side in its order."""
    each = F.struct(F.when(F.col("side") == "send", 0).otherwise(1).alias("s"), "pos", "token_id")
    return _order_legs(spark, d).groupBy("event_id").agg(F.array_sort(F.collect_list(each)).alias("l")).select("event_id", F.array_join("l.token_id", ",").alias("tokens"), F.size("l").alias("n_legs"))


def _sides(spark, d):
    each = _order_legs(spark, d)
    side = lambda name: F.collect_list(F.when(F.col("side") == name, F.col("usd"))).alias(f"{name}s")
    return each.groupBy("event_id").agg(side("send"), side("receive"))


def n2_leg_usd(spark, d):
    return X.legs(spark, d).select("event_id", "side", "pos", F.round(N.leg_usd(F.col("amount"), F.col("price")), 6).alias("usd"))


def n3_gross_usd(spark, d):
    return _sides(spark, d).select("event_id", F.round(N.gross_usd(F.col("sends"), F.col("receives")), 4).alias("gross_usd"))


def n4_asset_key(spark, d):
    joined = X.legs(spark, d).join(X.order_events(spark, d).select("event_id", "chain"), "event_id")
    token = F.when(F.col("pos") % 5 == 0, F.lit("ETH")).otherwise(F.col("token_id"))
    return joined.groupBy(N.asset_key(F.col("chain"), token).alias("asset_key")).agg(F.count("*").alias("n"))


_NATIVE = " ".join(f"WHEN chain = '{c}' AND lower(token) = '{t}' THEN '{v}'" for (c, t), v in N.NATIVE.items())
_MAPPED = " ".join(f"WHEN chain = '{c}' AND lower(token) LIKE '0x%' THEN '{v}:' || lower(token)" for c, v in N.PRICE_CHAINS.items())


def n5_action_class(spark, d):
    sides = _sides(spark, d).select("event_id", (F.size("sends") > 0).alias("s"), (F.size("receives") > 0).alias("r"))
    joined = X.order_events(spark, d).join(sides, "event_id", "left").fillna(False, ["s", "r"])
    approval = F.when(F.col("event_id").cast("long") % 17 == 0, "token")
    return joined.groupBy(N.action_class(approval, F.col("cex_id"), F.col("project_id"), F.col("s"), F.col("r")).alias("action_type")).agg(F.count("*").alias("n"))


def n6_primary_leg(spark, d):
    """The most valuable non-stable leg of each event: the first of equals, sends before receives; none if all are worth nothing."""
    each = _order_legs(spark, d).where((F.col("token_id") != X.STABLE) & (F.col("usd") > 0))
    order = F.struct(-F.col("usd"), F.when(F.col("side") == "send", 0).otherwise(1), F.col("pos"))
    return each.groupBy("event_id").agg(F.min_by(F.struct("token_id", "side", "pos", "usd"), order).alias("leg")).select("event_id", "leg.token_id", "leg.side", "leg.pos", F.round("leg.usd", 4).alias("usd"))


def n7_event_id(spark, d):
    tx = F.when(F.col("k") % 3 != 0, F.concat(F.lit("tx"), "event_id"))
    return X.events(spark, d).select("event_id", N.event_id(F.col("entity_id"), F.upper("wallet"), F.col("chain"), tx, F.col("k"), F.col("ts")).alias("hash"))


def n8_lookups(spark, d):
    """Exchange and project names by id, from small dictionaries joined on the left."""
    ev = X.events(spark, d)
    cex, project = (ev.select(F.col(c).alias("id")).where("id is not null").distinct().select("id", F.concat(F.lit(f"{n} "), F.upper("id")).alias("name")) for c, n in (("cex_id", "Exchange"), ("project_id", "Project")))
    named = ev.join(cex.select(F.col("id").alias("cex_id"), F.col("name").alias("cex_name")), "cex_id", "left").join(project.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")
    return named.select("event_id", "cex_name", "project_name")


def n9_valid_times(spark, d):
    raw = F.when(F.col("k") % 10 == 0, "bad").when(F.col("k") % 10 == 1, "-5").when(F.col("k") % 10 == 2, F.concat(F.col("ts").cast("string"), F.lit(".75"))).otherwise(F.col("ts").cast("string"))
    return X.events(spark, d).select("event_id", N.whole_seconds(raw).alias("at")).where("at > 0")


def n10_parse_time(spark, d):
    ts = F.col("ts").cast("string")
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(F.col("k") % 4 == 0, ts).when(F.col("k") % 4 == 1, F.concat(ts, F.lit("000"))).when(F.col("k") % 4 == 2, iso).otherwise("n/a")
    return X.events(spark, d).select("event_id", N.parse_epoch(raw).alias("at"))


def n11_action_token(spark, d):
    token = N.action_token(F.col("action_type"), F.col("cex_id"), F.col("project_id"), F.col("cate_id"))
    return X.events(spark, d).groupBy(token.alias("token")).agg(F.count("*").alias("n"))


def n12_chain_names(spark, d):
    """Each event's chain under the names of the price source, the block explorer, the node provider and the pool index."""
    tables = {"price_chain": N.PRICE_CHAINS, "explorer_chain": N.EXPLORER_CHAINS, "rpc_chain": N.RPC_CHAINS, "network": N.NETWORKS}
    return X.events(spark, d).select("event_id", *[N.lookup(F.col("chain"), names).alias(c) for c, names in tables.items()])


def e2_counterparties(spark, d):
    return episodes.counterparties(X.legs(spark, d))


def e3_nearest_link(spark, d):
    return episodes.nearest_links(X.events(spark, d), DAY)


def _placed(spark, d):
    return episodes.window_components(_windows(spark, d, DAY), episodes.nearest_links(X.events(spark, d), DAY))


def e4_components(spark, d):
    return _placed(spark, d).groupBy("component").agg(F.count("*").alias("n_events"), F.count_distinct("wallet", "window_start").alias("n_windows"))


def e5_chunks(spark, d):
    return windows.chunk(_placed(spark, d), ["entity_id", "component"], ["ts", "event_id"], 20).groupBy("component", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event"))


def e8_primary_asset(spark, d):
    placed = X.order_events(spark, d).withColumn("primary_asset_key", F.when(F.col("event_id").cast("long") % 3 == 0, F.lit("coingecko:ethereum"))).withColumn("usd_value", F.lit(0.0))
    return episodes.primary_asset(placed, ["event_id"], X.legs(spark, d))


def _episodes(spark, d):
    return episodes.build_episodes(X.events(spark, d), GAP)


def e9_rollup(spark, d):
    return _episodes(spark, d).select("episode_id", "entity_id", "start_ts", "end_ts", F.array_join("wallets", ",").alias("wallets"), "motif", "chain", "gross_usd", "n_events", "primary_asset_key", F.array_join("patterns", ";").alias("patterns"))


def e10_majority_chain(spark, d):
    day = (F.floor(F.col("ts") / (7 * DAY))).alias("week")
    ev = X.events(spark, d).select("entity_id", day, F.concat("chain", F.col("k") % 3).alias("chain"), F.struct("ts", "event_id").alias("seq"))
    return windows.majority(ev, ["entity_id", "week"], "chain", "seq")


def e11_episode_id(spark, d):
    return _episodes(spark, d).select("episode_id", "entity_id", F.array_join("event_ids", ",").alias("event_ids"))


def _hourly_episodes(spark, d):
    return X.events(spark, d).select("event_id", "entity_id", "chain", F.col("ts").alias("start_ts"))


def e12_context_asof(spark, d):
    found = episodes.context_asof(_hourly_episodes(spark, d), X.series(spark, d), ["entity_id"], CONTEXTS)
    return found.select("event_id", *[F.round(f"ctx_{k}", 6).alias(k) for k in CONTEXTS])


def e13_wallet_context(spark, d):
    ev = X.events(spark, d)
    series = ev.select("wallet", F.lit("history").alias("kind"), "chain", F.col("ts").alias("time"), F.col("usd_value").alias("value"), F.lit(0).alias("captured_at"), "event_id")
    series = series.groupBy("wallet", "kind", "chain", "time", "captured_at").agg(F.max("value").alias("value"))
    probes = ev.select("event_id", "wallet", "chain", (F.col("ts") - 3600).alias("start_ts"))
    return episodes.context_asof(probes, series, ["wallet"], ("history",)).select("event_id", F.col("ctx_history").alias("history"))


def e14_enrichment(spark, d):
    ev = X.events(spark, d).withColumn("tx_hash", F.concat(F.lit("tx"), F.col("event_id").cast("long") % 900))
    enrich = ev.where("k % 6 in (0, 1)").groupBy("tx_hash", "chain", F.when(F.col("k") % 6 == 0, "status").otherwise("trace").alias("source")).agg(F.max("event_id").alias("payload"))
    found = episodes.attach_enrichment(ev, enrich)
    return found.select("event_id", F.coalesce(F.size("tx_enrichments"), F.lit(0)).alias("n"), F.col("tx_enrichments").getItem("status").alias("status"))


def e15_dirty_windows(spark, d):
    return windows.dirty_windows(X.events(spark, d).where("k % 37 = 0"), GAP)


def e16_affected(spark, d):
    ev = X.events(spark, d)
    dirty = windows.dirty_windows(ev.where("k = 7 and wallet in ('w0', 'w5', 'w7')"), 3600)
    return windows.affected_subsessions(ev, dirty, ["entity_id", "wallet"], 3600).groupBy("entity_id", "wallet").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _versions(spark, d):
    ev = X.events(spark, d)
    day = F.floor(F.col("ts") / DAY).alias("day")
    roll = lambda x: x.groupBy("wallet", day).agg(F.count("*").alias("n"), F.max("k").alias("top")).select(F.concat_ws("|", "wallet", "day").alias("episode_id"), episodes.input_hash("v1", "n", "top").alias("input_hash"), "n")
    return roll(ev.where("k % 11 != 0")), roll(ev.where("k % 13 != 0"))


def e17_replaced(spark, d):
    old, new = _versions(spark, d)
    return episodes.replaced(old, new).select("episode_id", "n")


def e18_changed(spark, d):
    old, new = _versions(spark, d)
    return episodes.changed(old, new, "episode_id").select("episode_id", "change")


def e19_label_merge(spark, d):
    old, new = _versions(spark, d)
    old = old.withColumn("intent_label", F.when(F.col("n") > 1, "buy").otherwise("sell"))
    return episodes.merge_labels(old, new).select("episode_id", "intent_label")


_VERSIONS = f"""{EV}, o AS (SELECT wallet || '|' || CAST(floor(ts / {DAY}) AS BIGINT) AS episode_id, count(*) AS n, max(k) AS top FROM ev WHERE k % 11 <> 0 GROUP BY 1),
  w AS (SELECT wallet || '|' || CAST(floor(ts / {DAY}) AS BIGINT) AS episode_id, count(*) AS n, max(k) AS top FROM ev WHERE k % 13 <> 0 GROUP BY 1)"""

QUERIES = {
    name: f
    for name, f in list(globals().items())
    if name[:1] in "en" and name[1:2].isdigit()
}

ORACLES = {
    "e1_anchored_windows": f"WITH {windows_sql(DAY)} SELECT entity_id, wallet, window_start, count(*) AS n, max(ts) AS end_ts FROM win GROUP BY ALL",
    "e6_motif": f"WITH {SEQUENCES} SELECT entity_id, wallet, window_start, array_to_string(tokens, '>') AS motif FROM seq",
    "e7_patterns": f"WITH {SEQUENCES} SELECT entity_id, wallet, window_start, unnest({patterns_sql('tokens')}) AS pattern FROM seq",
    "n1_legs": f"WITH {LEGS} SELECT event_id, string_agg(token_id, ',' ORDER BY CASE side WHEN 'send' THEN 0 ELSE 1 END, pos) AS tokens, CAST(count(*) AS INT) AS n_legs FROM legs GROUP BY event_id",
    "n2_leg_usd": f"WITH {LEGS} SELECT event_id, side, CAST(pos AS INT) AS pos, round(abs(amount * price), 6) AS usd FROM legs",
    "n3_gross_usd": f"WITH {LEGS} SELECT event_id, round(greatest(sum(CASE WHEN side = 'send' THEN abs(amount * price) ELSE 0 END), sum(CASE WHEN side = 'receive' THEN abs(amount * price) ELSE 0 END)), 4) AS gross_usd FROM legs GROUP BY event_id",
    "n4_asset_key": f"WITH {ORD}, {LEGS} SELECT CASE {_NATIVE} {_MAPPED} END AS asset_key, count(*) AS n FROM (SELECT chain, CASE WHEN pos % 5 = 0 THEN 'ETH' ELSE token_id END AS token FROM legs JOIN ord USING (event_id)) GROUP BY 1",
    "n5_action_class": f"""WITH {ORD}, {LEGS}, s AS (SELECT event_id, bool_or(side = 'send') AS s, bool_or(side = 'receive') AS r FROM legs GROUP BY 1),
      j AS (SELECT ord.*, coalesce(s, false) AS s, coalesce(r, false) AS r FROM ord LEFT JOIN s USING (event_id)),
      c AS (SELECT *, CASE WHEN s AND r THEN '_BIDIRECTIONAL' WHEN s THEN '_OUT' WHEN r THEN '_IN' ELSE '' END AS side FROM j)
      SELECT CASE WHEN CAST(event_id AS BIGINT) % 17 = 0 THEN 'APPROVAL' WHEN cex_id IS NOT NULL THEN 'CEX_INTERACTION' || side WHEN project_id IS NOT NULL THEN 'DEFI_INTERACTION' || side
        WHEN s AND r THEN 'ASSET_EXCHANGE_LIKE' WHEN s THEN 'TRANSFER_OUT' WHEN r THEN 'TRANSFER_IN' ELSE 'CONTRACT_INTERACTION' END AS action_type, count(*) AS n FROM c GROUP BY 1""",
    "n6_primary_leg": f"""WITH {LEGS} SELECT event_id, token_id, side, CAST(pos AS INT) AS pos, round(usd, 4) AS usd FROM (SELECT *, abs(amount * price) AS usd, row_number() OVER (PARTITION BY event_id ORDER BY abs(amount * price) DESC,
      CASE side WHEN 'send' THEN 0 ELSE 1 END, pos) AS r FROM legs WHERE token_id <> 'usdc' AND abs(amount * price) > 0) WHERE r = 1""",
    "n7_event_id": f"""WITH {EV} SELECT event_id, sha256('["' || entity_id || '","' || wallet || '","' || chain || '",' || CASE WHEN k % 3 <> 0 THEN '"tx' || event_id || '"' ELSE 'null' END || ',' || k || ',' || ts || ']') AS hash FROM ev""",
    "n8_lookups": f"WITH {EV} SELECT event_id, 'Exchange ' || upper(cex_id) AS cex_name, 'Project ' || upper(project_id) AS project_name FROM ev",
    "n9_valid_times": f"WITH {EV} SELECT event_id, ts AS at FROM ev WHERE k % 10 NOT IN (0, 1) AND ts > 0",
    "n10_parse_time": f"WITH {EV} SELECT event_id, CASE WHEN k % 4 <> 3 THEN ts END AS at FROM ev",
    "n11_action_token": f"WITH {EV} SELECT {TOKEN} AS token, count(*) AS n FROM ev GROUP BY 1",
    "n12_chain_names": f"WITH {EV} SELECT event_id, CASE chain WHEN 'eth' THEN 'ethereum' WHEN 'arb' THEN 'arbitrum' WHEN 'op' THEN 'optimism' ELSE chain END AS price_chain, CASE chain WHEN 'arb' THEN 'arbitrum' WHEN 'op' THEN 'optimism' ELSE chain END AS explorer_chain, price_chain AS rpc_chain, price_chain AS network FROM ev",
    "e2_counterparties": f"WITH {LEGS} SELECT DISTINCT event_id, lower(addr) AS counterparty FROM legs WHERE addr IS NOT NULL",
    "e3_nearest_link": f"WITH {EV}, {links_sql(DAY)} SELECT * FROM links",
    "e4_components": f"WITH {windows_sql(DAY)}, {links_sql(DAY)}, {COMPONENTS} SELECT component, count(*) AS n_events, count(DISTINCT node) AS n_windows FROM plc GROUP BY 1",
    "e5_chunks": f"""WITH {windows_sql(DAY)}, {links_sql(DAY)}, {COMPONENTS} SELECT component, chunk, count(*) AS n, min(event_id) AS least_event FROM
      (SELECT *, (row_number() OVER (PARTITION BY entity_id, component ORDER BY ts, event_id) - 1) // 20 AS chunk FROM plc) GROUP BY 1, 2""",
    "e8_primary_asset": f"""WITH {ORD}, {LEGS}, w AS (SELECT event_id, 9 AS s, 0 AS pos, 'coingecko:ethereum' AS a, 1.0::DOUBLE AS w FROM ord WHERE CAST(event_id AS BIGINT) % 3 = 0
      UNION ALL SELECT event_id, CASE side WHEN 'send' THEN 0 ELSE 1 END, pos, a, CASE WHEN usd > 0 THEN usd ELSE 1.0 END FROM (SELECT event_id, side, pos, abs(amount * price) AS usd, CASE {_NATIVE} {_MAPPED} END AS a
      FROM (SELECT l.*, o.chain, l.token_id AS token FROM legs l JOIN ord o USING (event_id))) WHERE a IS NOT NULL),
      t AS (SELECT event_id, a, round(sum(w), 6) AS w, min((s, pos)) AS f FROM w GROUP BY 1, 2) SELECT event_id, arg_min(a, (-w, f)) AS primary_asset_key FROM t GROUP BY 1""",
    "e9_rollup": f"""WITH {episodes_sql(GAP)} SELECT episode_id, entity_id, start_ts, end_ts, array_to_string(wallets, ',') AS wallets, motif, chain, gross_usd, n_events, primary_asset_key, array_to_string({patterns_sql('tokens')}, ';') AS patterns
      FROM eps JOIN chn USING (entity_id, component, chunk) LEFT JOIN ast USING (entity_id, component, chunk)""",
    "e10_majority_chain": f"WITH {EV} SELECT entity_id, week, arg_min(c, (-n, f)) AS chain FROM (SELECT entity_id, CAST(floor(ts / {7 * DAY}) AS BIGINT) AS week, chain || (k % 3) AS c, count(*) AS n, min((ts, event_id)) AS f FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "e11_episode_id": f"WITH {episodes_sql(GAP)} SELECT episode_id, entity_id, array_to_string(event_ids, ',') AS event_ids FROM eps",
    "e12_context_asof": f"""WITH {EV}, {SNAP}, p AS (SELECT event_id, entity_id, chain, ts FROM ev), n AS (SELECT entity_id, kind, chain, time, arg_max(value, captured_at) AS value FROM snap GROUP BY ALL),
      """ + ", ".join(f"c_{k} AS (SELECT p.event_id, n.value FROM p ASOF JOIN (SELECT * FROM n WHERE kind = '{k}') n ON p.entity_id = n.entity_id AND p.chain = n.chain AND p.ts >= n.time)" for k in CONTEXTS)
    + " SELECT p.event_id, " + ", ".join(f"round(c_{k}.value, 6) AS {k}" for k in CONTEXTS) + " FROM p " + " ".join(f"LEFT JOIN c_{k} ON c_{k}.event_id = p.event_id" for k in CONTEXTS),
    "e13_wallet_context": f"""WITH {EV}, s AS (SELECT wallet, chain, ts AS time, max(usd_value) AS value FROM ev GROUP BY ALL), p AS (SELECT event_id, wallet, chain, ts - 3600 AS ts FROM ev)
      SELECT p.event_id, s.value AS history FROM p ASOF LEFT JOIN s ON p.wallet = s.wallet AND p.chain = s.chain AND p.ts >= s.time""",
    "e14_enrichment": f"""WITH {EV}, t AS (SELECT *, 'tx' || (CAST(event_id AS BIGINT) % 900) AS tx_hash FROM ev), n AS (SELECT tx_hash, chain, CASE WHEN k % 6 = 0 THEN 'status' ELSE 'trace' END AS source, max(event_id) AS payload FROM t WHERE k % 6 IN (0, 1) GROUP BY ALL)
      SELECT t.event_id, CAST(count(n.source) AS INT) AS n, max(CASE WHEN n.source = 'status' THEN n.payload END) AS status FROM t LEFT JOIN n ON n.tx_hash = t.tx_hash AND n.chain = t.chain GROUP BY t.event_id""",
    "e15_dirty_windows": f"""WITH {EV}, f AS (SELECT entity_id, ts, CASE WHEN ts - lag(ts) OVER w <= {2 * GAP} THEN 0 ELSE 1 END AS fresh FROM ev WHERE k % 37 = 0 WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
      r AS (SELECT entity_id, ts, sum(fresh) OVER (PARTITION BY entity_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT entity_id, min(ts) - {GAP} AS from_ts, max(ts) + {GAP} AS to_ts FROM r GROUP BY entity_id, run""",
    "e16_affected": f"""WITH {EV}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 3600 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY entity_id, wallet ORDER BY ts)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_id, wallet ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f), b AS (SELECT entity_id, wallet, run, min(ts) AS a, max(ts) AS z FROM r GROUP BY ALL),
      d AS (SELECT entity_id, ts - 3600 AS a, ts + 3600 AS z FROM ev WHERE k = 7 AND wallet IN ('w0', 'w5', 'w7')),
      h AS (SELECT DISTINCT b.entity_id, b.wallet, b.run FROM b JOIN d ON b.entity_id = d.entity_id AND b.a <= d.z AND b.z >= d.a),
      e AS (SELECT r.* FROM r JOIN h USING (entity_id, wallet, run)) SELECT entity_id, wallet, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY 1, 2""",
    "e17_replaced": f"WITH {_VERSIONS} SELECT episode_id, n FROM o WHERE episode_id NOT IN (SELECT episode_id FROM w)",
    "e18_changed": f"WITH {_VERSIONS} SELECT episode_id, CASE WHEN o.episode_id IS NULL THEN 'added' WHEN w.episode_id IS NULL THEN 'removed' WHEN o.n = w.n AND o.top = w.top THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN w USING (episode_id)",
    "e19_label_merge": f"WITH {_VERSIONS} SELECT episode_id, CASE WHEN o.n = w.n AND o.top = w.top THEN CASE WHEN o.n > 1 THEN 'buy' ELSE 'sell' END END AS intent_label FROM w LEFT JOIN o USING (episode_id)",
}
