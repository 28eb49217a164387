"""Intent of an episode: flow features over its legs, additive rules, and the best label unless the evidence is ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.normalize import STABLE_IDS, asset_key

#: Markers searched for in lower-cased text.
STABLE_MARKERS = ("usdc", "usdt", "dai", "tusd", "busd", "usde", "usds", "frax", "stable")
BRIDGE_MARKERS = ("bridge", "stargate", "across", "hop protocol", "wormhole", "layerzero", "synapse", "celer")
LIQUIDITY_MARKERS = ("liquidity", "liquidity pool", " lp ", "lp_", "_lp", "pool deposit", "pool withdrawal")
SUCCESS_MARKERS = ("success", "succeeded", "completed", "complete", "done", "filled")
STATUS_SOURCES = ("lifi_status", "rubic_status")
#: The labels that rules add to.
LABELS = ("accumulation", "asset_rotation", "bridge_reposition", "buy", "distribution", "internal_rebalance", "inventory_rebalance", "liquidity_management", "sell")


def has_any(text: Column, markers: tuple[str, ...]) -> Column:
    return text.rlike("|".join(markers))


def is_stable(token: Column, symbol: Column | None = None, name: Column | None = None) -> Column:
    """A known stable id, or a marker in the token's id, symbol or name."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (token, symbol, name) if x is not None]))
    return F.lower(F.coalesce(token, F.lit(""))).isin(*STABLE_IDS) | has_any(text, STABLE_MARKERS)


def leg_value(amount: Column, price: Column) -> Column:
    """abs(amount * price), or 1 where that is zero or no number."""
    value = F.abs(F.coalesce(amount.try_cast("double"), F.lit(0.0)) * F.coalesce(price.try_cast("double"), F.lit(0.0)))
    return F.when((value > 0) & ~F.isnan(value) & (value != F.lit(float("inf"))), value).otherwise(1.0)


def bridge_success(source: Column, payload: Column) -> Column:
    """Whether an enrichment's text, to 8000 characters, shows a completed cross-chain transfer."""
    text = F.substring(F.lower(payload), 1, 8000)
    done = has_any(text, SUCCESS_MARKERS)
    return F.coalesce(done & (has_any(text, BRIDGE_MARKERS) | source.isin(*STATUS_SOURCES)), F.lit(False))


def leg_flows(events: DataFrame, legs: DataFrame, owned: DataFrame) -> DataFrame:
    """One row per leg of an episode's events: episode_id, side, asset, value, stable, counterparty, owned. `owned` has entity_id, address: the accounts of each entity."""
    each = events.select("episode_id", "entity_id", "event_id", "chain", "wallet", *(["other_addr"] if "other_addr" in events.columns else [])).join(legs, "event_id")
    other = F.col("other_addr") if "other_addr" in events.columns else F.lit(None).cast("string")
    each = each.withColumn("counterparty", F.coalesce(F.nullif("addr", F.lit("")), other))
    known = owned.select("entity_id", F.col("address").alias("counterparty"), F.lit(True).alias("_known")).distinct()
    joined = each.join(known, ["entity_id", "counterparty"], "left")
    asset = F.coalesce(asset_key(F.col("chain"), F.col("token_id")), F.lower(F.nullif("token_id", F.lit(""))), F.lit("unknown"))
    own = F.coalesce("_known", F.lit(False)) & (F.col("counterparty") != F.col("wallet"))
    return joined.select("episode_id", "event_id", "side", asset.alias("asset"), leg_value(F.col("amount"), F.col("price")).alias("value"), is_stable(F.col("token_id")).alias("stable"), "counterparty", F.coalesce(own, F.lit(False)).alias("own"), F.coalesce("_known", F.lit(False)).alias("known"))


def _counts(column: str) -> Column:
    """How often each value occurs in an episode, which is bounded: a map in order of the values, without empty ones."""
    names = F.array_sort(F.collect_list(F.nullif(F.col(column), F.lit(""))))
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda x: F.struct(x, F.size(F.filter(names, lambda y: y == x)).cast("long"))))


def intent_features(events: DataFrame, legs: DataFrame, owned: DataFrame, enrich: DataFrame | None = None) -> DataFrame:
    """One row per episode of `events` (episode_id on each event): values sent and received, stable or not; own and external legs; distinct external recipients; asset maps; counts of actions, projects, categories and exchanges; bridge and liquidity evidence."""
    flows = leg_flows(events, legs, owned)
    sent, got = F.col("side") == "send", F.col("side") == "receive"
    total = lambda cond, name: F.round(F.sum(F.when(cond, F.col("value")).otherwise(0.0)), 6).alias(name)
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    sums = flows.groupBy("episode_id").agg(
        total(sent & F.col("stable"), "stable_sent"), total(got & F.col("stable"), "stable_received"), total(sent & ~F.col("stable"), "risk_sent"), total(got & ~F.col("stable"), "risk_received"),
        count(sent, "send_count"), count(got, "receive_count"), count(F.col("own"), "own_count"), count(sent & ~F.col("own"), "external_out"), count(got & ~F.col("own"), "external_in"),
        F.count_distinct(F.when(sent & ~F.col("known"), F.col("counterparty"))).alias("recipients"),
    )
    by_asset = flows.groupBy("episode_id", "side", "asset").agg(F.round(F.sum("value"), 6).alias("value"))
    held = lambda side: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("asset", "value")))))
    assets = by_asset.groupBy("episode_id").agg(held("send").alias("send_assets"), held("receive").alias("receive_assets"))
    meta = F.lower(F.concat_ws(" ", "action_type", "project_id", "cate_id"))
    venues = [c for c in ("project_id", "cate_id", "cex_id") if c in events.columns]
    marked = events.select("episode_id", F.upper(F.coalesce("action_type", F.lit("unknown"))).alias("action"), meta.alias("meta"), *venues, *([] if enrich is None else ["tx_hash", "chain"]))
    acts = marked.groupBy("episode_id").agg(
        F.count("*").alias("event_count"), F.count(F.when(F.col("action") == "CEX_INTERACTION_IN", 1)).alias("cex_in"), F.count(F.when(F.col("action") == "CEX_INTERACTION_OUT", 1)).alias("cex_out"),
        F.count(F.when(F.col("action").rlike("BIDIRECTIONAL|EXCHANGE_LIKE"), 1)).alias("two_way"), F.bool_or(has_any(F.col("meta"), BRIDGE_MARKERS)).alias("bridge"),
        F.bool_or(has_any(F.concat(F.lit(" "), "meta", F.lit(" ")), LIQUIDITY_MARKERS) | F.col("action").startswith("LP_")).alias("liquidity"),
        _counts("action").alias("action_counts"), *[_counts(c).alias(f"{c.removesuffix('_id')}_counts") for c in venues],
    )
    out = acts.join(sums, "episode_id", "left").join(assets, "episode_id", "left")
    if enrich is not None:
        done = enrich.groupBy("tx_hash", "chain").agg(F.bool_or(bridge_success(F.col("source"), F.col("payload"))).alias("_ok"))
        crossed = marked.join(done, ["tx_hash", "chain"]).groupBy("episode_id").agg(F.bool_or("_ok").alias("_crossed"))
        out = out.join(crossed, "episode_id", "left").withColumn("bridge", F.col("bridge") | F.coalesce("_crossed", F.lit(False))).drop("_crossed")
    numbers = [c for c, t in sums.dtypes if t in ("double", "bigint")]
    return out.fillna(0, numbers)


def target_flow(target: Column, assets: Column) -> Column:
    """What moved of the episode's target asset; 0 where it is absent."""
    return F.coalesce(F.try_element_at(assets, target), F.lit(0.0))


def score_columns() -> dict[str, Column]:
    """The score that each label's rules add up to, over the columns of intent_features()."""
    c = F.col
    add = lambda *pairs: sum((F.when(F.coalesce(cond, F.lit(False)), F.lit(w)).otherwise(0.0) for cond, w in pairs), F.lit(0.0))
    positive = lambda m: F.array_sort(F.map_keys(F.map_filter(F.coalesce(c(m), F.create_map().cast("map<string,double>")), lambda k, v: v > 0)))
    same = positive("send_assets") == positive("receive_assets")
    so, si, ro, ri = c("stable_sent"), c("stable_received"), c("risk_sent"), c("risk_received")
    own_most = c("own_count") >= c("external_out") + c("external_in")
    one_way_out = (ro > 0) & (ri == 0) & (si == 0) & (c("external_out") > 0)
    return {
        "accumulation": add(((c("cex_in") > 0) & (ri > 0) & (ro == 0), 4.5), ((ri > 0) & (ro == 0) & (so == 0) & (c("external_in") > 0), 3.0)),
        "asset_rotation": add(((ro > 0) & (ri > 0) & (so == 0) & (si == 0) & ~same, 6.0)),
        "bridge_reposition": add((c("bridge"), 8.0)),
        "buy": add(((so > 0) & (ri > 0), 6.0)),
        "distribution": add((one_way_out & (c("recipients") >= 2), 4.5), (one_way_out & (c("recipients") < 2), 2.0)),
        "internal_rebalance": add(((c("own_count") > 0) & own_most, 8.0), ((c("own_count") > 0) & ~own_most, 4.0)),
        "inventory_rebalance": add(((c("two_way") > 0) & ~c("bridge") & ~c("liquidity"), 3.0), ((ri > 0) & (ro > 0) & same, 4.0)),
        "liquidity_management": add((c("liquidity"), 7.0)),
        "sell": add(((ro > 0) & (si > 0), 6.0), ((c("cex_out") > 0) & (ro > 0) & (ri == 0), 4.5)),
    }


#: What each rule family says for itself.
REASONS = {
    "accumulation": "inventory of non-stable assets received",
    "asset_rotation": "different non-stable assets sent and received",
    "bridge_reposition": "cross-chain evidence",
    "buy": "stable sent, non-stable received",
    "distribution": "non-stable inventory sent to outside recipients",
    "internal_rebalance": "legs between the entity's own accounts",
    "inventory_rebalance": "assets moved in both directions",
    "liquidity_management": "liquidity evidence",
    "sell": "non-stable sent out for stable or to an exchange",
}


def classify(features: DataFrame) -> DataFrame:
    """Adds scores (labels of positive score), intent_label, confidence and reasons. Unknown where the best score is under 3, or the second is 3 or more and within 1.5 of it."""
    scored = features.withColumns({f"_s_{k}": v for k, v in score_columns().items()})
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"_s_{k}")).alias("m"), F.lit(k).alias("label")) for k in LABELS]), lambda x: x["m"] < 0))
    ranked = scored.withColumn("_r", ranked)
    top = F.coalesce(-F.try_element_at(F.col("_r"), F.lit(1))["m"], F.lit(0.0))
    second = F.coalesce(-F.try_element_at(F.col("_r"), F.lit(2))["m"], F.lit(0.0))
    ambiguous = (top < 3.0) | ((second >= 3.0) & (top - second < 1.5))
    sure = F.least(F.lit(0.99), 0.62 + 0.045 * top + 0.035 * F.least(top - second, F.lit(4.0)))
    confidence = F.when(F.size("_r") == 0, 0.80).when(ambiguous, 0.45).otherwise(sure)
    label = F.when(ambiguous, "unknown").otherwise(F.try_element_at(F.col("_r"), F.lit(1))["label"])
    out = ranked.withColumn("intent_label", label).withColumn("confidence", F.bround(confidence, 4))
    out = out.withColumn("scores", F.map_from_entries(F.transform("_r", lambda x: F.struct(x["label"], -x["m"]))))
    said = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    reasons = F.when(F.size("_r") == 0, F.array(F.lit("no directional evidence"))).when(F.col("intent_label") == "unknown", F.transform(F.slice("_r", 1, 3), lambda x: F.concat(x["label"], F.lit("="), (-x["m"]).cast("string")))).otherwise(F.array(said[F.col("intent_label")]))
    return out.withColumn("reasons", reasons).drop("_r", *[f"_s_{k}" for k in LABELS])


def pre_event_profile(ev: DataFrame) -> DataFrame:
    """event_id with the account's totals over strictly earlier times: prior_n, prior_usd."""
    before = Window.partitionBy("wallet").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    return ev.select("event_id", F.count("*").over(before).alias("prior_n"), F.round(F.coalesce(F.sum("usd_value").over(before), F.lit(0.0)), 4).alias("prior_usd"))


def pre_event_counts(ev: DataFrame, by: str) -> DataFrame:
    """event_id, <by>, prior_n: for each value that the account showed strictly before the event, how often; from running counts, as of the event's time."""
    steps = ev.where(F.col(by).isNotNull()).groupBy("wallet", by, "ts").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("wallet", by).orderBy("ts")
    steps = steps.withColumn("prior_n", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("ts").over(order))
    day = 86400
    # Each running count holds over a span of times; spans and events meet on whole days.
    spans = steps.select("wallet", by, "prior_n", F.col("ts").alias("_from"), F.col("_next"))
    last = ev.groupBy("wallet").agg(F.max("ts").alias("_last"))
    spans = spans.join(last, "wallet").withColumn("_to", F.coalesce("_next", "_last")).withColumn("_day", F.explode(F.sequence(F.floor(F.col("_from") / day), F.floor(F.col("_to") / day))))
    probes = ev.select("event_id", "wallet", F.col("ts").alias("_t"), F.floor(F.col("ts") / day).alias("_day"))
    hit = (F.col("_t") > F.col("_from")) & (F.col("_next").isNull() | (F.col("_t") <= F.col("_next")))
    return probes.join(spans, ["wallet", "_day"]).where(hit).select("event_id", by, "prior_n")


def unclassified(ep: DataFrame, force: bool = False, from_ts: int | None = None, to_ts: int | None = None, limit: int | None = None) -> DataFrame:
    """Episodes to classify: without a label unless force, within the dates, oldest first."""
    out = ep if force else ep.where(F.col("intent_label").isNull())
    out = out if from_ts is None else out.where(F.col("start_ts") >= from_ts)
    out = out if to_ts is None else out.where(F.col("start_ts") <= to_ts)
    return out if limit is None else out.orderBy("start_ts", "episode_id").limit(limit)


def label_summary(ep: DataFrame, by: str = "entity_id") -> DataFrame:
    """Per key: episodes, unknown ones, labelled ones, mean confidence."""
    return ep.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("intent_label") == "unknown").alias("n_unknown"), F.count_if(F.col("intent_label").isNotNull()).alias("n_labelled"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
