"""Episodes: anchored windows joined across an entity's accounts by nearest links, cut to bounded size and rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.normalize import STABLE_IDS, action_token, asset_key, json_text
from tracewright.functions.patterns import motif, patterns
from tracewright.operators.asof import asof_kinds, nearest
from tracewright.operators.graph import connected_components
from tracewright.operators.windows import anchored_windows, chunk


def counterparties(legs: DataFrame) -> DataFrame:
    """event_id, counterparty: distinct lower-cased addresses on the other side of an event's legs."""
    return legs.where(F.coalesce("addr", F.lit("")) != "").select("event_id", F.lower("addr").alias("counterparty")).distinct()


def nearest_links(ev: DataFrame, gap: int) -> DataFrame:
    """event_id, linked_event_id: for each counterparty that is another account of the same entity with events here, its nearest event within `gap`; at or after wins ties."""
    known = ev.select("entity_id", F.col("wallet").alias("counterparty")).distinct()
    probes = ev.where(F.col("counterparty").isNotNull() & (F.col("counterparty") != F.col("wallet"))).join(known, ["entity_id", "counterparty"], "left_semi")
    right = ev.select("entity_id", F.col("wallet").alias("counterparty"), "ts", "event_id")
    found = nearest(probes.select("entity_id", "counterparty", "ts", "event_id"), right, ["entity_id", "counterparty"], "ts", "event_id", gap)
    return found.where("match is not null").select("entity_id", "event_id", F.col("match.event_id").alias("linked_event_id"))


def node(entity: str, wallet: str, start: str) -> Column:
    return F.concat_ws("|", entity, wallet, F.lpad(F.col(start).cast("string"), 12, "0"))


def window_components(windows: DataFrame, links: DataFrame) -> DataFrame:
    """Adds component to events with window_start: windows that links connect, named by the least node (entity|wallet|start)."""
    placed = windows.withColumn("_node", node("entity_id", "wallet", "window_start"))
    ends = placed.select("event_id", "_node")
    edges = links.join(ends.withColumnRenamed("_node", "src"), "event_id").join(ends.select(F.col("event_id").alias("linked_event_id"), F.col("_node").alias("dst")), "linked_event_id").select("src", "dst")
    found = connected_components(edges).withColumnRenamed("node", "_node")
    return placed.join(found, "_node", "left").withColumn("component", F.coalesce("component", "_node")).drop("_node")


def episode_id(entity: Column, ids: Column) -> Column:
    """sha256 of the compact JSON list of entity and event ids."""
    return F.sha2(F.concat(F.lit("["), json_text(entity), F.lit(",["), F.array_join(F.transform(ids, json_text), ","), F.lit("]]")), 256)


def primary_asset(placed: DataFrame, keys: list[str], legs: DataFrame | None = None) -> DataFrame:
    """keys, primary_asset_key: the asset of most weight. Weights: each non-stable leg's USD value (1 when zero), plus an event's own value (1 when zero) on its primary asset; ties go to the one seen first."""
    own = placed.where(F.col("primary_asset_key").isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "ts", "event_id", F.lit(9).alias("_side"), F.lit(0).alias("pos"), F.col("primary_asset_key").alias("_asset"), F.coalesce(F.nullif("usd_value", F.lit(0.0)), F.lit(1.0)).alias("_w"))
    weights = own
    if legs is not None:
        each = placed.select(*dict.fromkeys([*keys, "ts", "event_id", "chain"])).join(legs, "event_id").where(~F.lower("token_id").isin(*STABLE_IDS))
        key = asset_key(F.col("chain"), F.col("token_id"))
        value = F.abs(F.coalesce("amount", F.lit(0.0)) * F.coalesce("price", F.lit(0.0)))
        side = F.when(F.col("side") == "send", 0).otherwise(1)
        weights = own.unionByName(each.where(key.isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "ts", "event_id", side.alias("_side"), "pos", key.alias("_asset"), F.when(value > 0, value).otherwise(1.0).alias("_w")))
    summed = weights.groupBy(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)], "_asset").agg(F.round(F.sum("_w"), 6).alias("_w"), F.min(F.struct("ts", "event_id", "_side", "pos")).alias("_first"))
    return summed.groupBy(*keys).agg(F.min_by("_asset", F.struct(-F.col("_w"), F.col("_first"))).alias("primary_asset_key"))


def rollup(placed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per episode: episode_id, entity_id, start_ts, end_ts, wallets, event_ids, motif, patterns, chain, gross_usd, n_events. Groups must be bounded (chunk())."""
    token = action_token(F.col("action_type"), F.col("cex_id"), F.col("project_id"), F.col("cate_id"))
    seq = F.struct("ts", "event_id")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", token.alias("token"))))
    grouped = placed.groupBy("entity_id", *keys).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.array_sort(F.collect_set("wallet")).alias("wallets"), ordered.alias("_seq"), F.round(F.sum("usd_value"), 6).alias("gross_usd"), F.count("*").alias("n_events"))
    chains = placed.groupBy("entity_id", *keys, "chain").agg(F.count("*").alias("_n"), F.min(seq).alias("_first")).groupBy("entity_id", *keys).agg(F.min_by("chain", F.struct(-F.col("_n"), F.col("_first"))).alias("chain"))
    tokens, ids = F.col("_seq.token"), F.col("_seq.event_id")
    both = grouped.join(chains, ["entity_id", *keys])
    return both.select(episode_id(F.col("entity_id"), ids).alias("episode_id"), "entity_id", *keys, "start_ts", "end_ts", "wallets", ids.alias("event_ids"), motif(tokens).alias("motif"), patterns(tokens).alias("patterns"), "chain", "gross_usd", "n_events")


def build_episodes(ev: DataFrame, gap: int = 21600, max_events: int = 50, legs: DataFrame | None = None, cross_links: bool = True) -> DataFrame:
    """Episodes of all events: windows, links, components, chunks of at most max_events, roll-up and primary asset."""
    windows = anchored_windows(ev, ["entity_id", "wallet"], gap)
    if cross_links:
        placed = window_components(windows, nearest_links(ev, gap))
    else:
        placed = windows.withColumn("component", node("entity_id", "wallet", "window_start"))
    placed = chunk(placed, ["entity_id", "component"], ["ts", "event_id"], max_events)
    keys = ["component", "chunk"]
    return rollup(placed, keys).join(primary_asset(placed, ["entity_id", *keys], legs), ["entity_id", *keys], "left").drop(*keys)


def context_asof(ep: DataFrame, series: DataFrame, by: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """Adds ctx_<kind> for each kind: the series' latest value at or before start_ts on the episode's chain, from its newest captured version; of equal times the first."""
    newest = series.groupBy(*by, "kind", "chain", "time").agg(F.max_by("value", "captured_at").alias("value"))
    return asof_kinds(ep, newest.withColumnRenamed("time", "start_ts"), [*by, "chain"], "start_ts", kinds)


def attach_enrichment(ev: DataFrame, enrich: DataFrame) -> DataFrame:
    """Adds tx_enrichments: a map from source to payload for the event's (tx_hash, chain); null where there is none."""
    by_tx = enrich.groupBy("tx_hash", "chain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "payload")))).alias("tx_enrichments"))
    return ev.join(by_tx, ["tx_hash", "chain"], "left")


def input_hash(version: str, *cols: str) -> Column:
    """Hash of a version and of inputs, nulls included."""
    return F.sha2(F.concat_ws("|", F.lit(version), *[json_text(F.col(c).cast("string")) for c in cols]), 256)


def changed(old: DataFrame, new: DataFrame, key: str, hash_col: str = "input_hash") -> DataFrame:
    """key, change: added, removed, changed or same, by comparing input hashes."""
    a, b = old.select(key, F.col(hash_col).alias("_old"), F.lit(1).alias("_o")), new.select(key, F.col(hash_col).alias("_new"), F.lit(1).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def merge_labels(old: DataFrame, new: DataFrame, key: str = "episode_id") -> DataFrame:
    """New episodes, each with the old intent where its input hash did not change."""
    kept = old.select(key, F.col("input_hash").alias("_hash"), F.col("intent_label").alias("_intent"))
    return new.join(kept, key, "left").withColumn("intent_label", F.when(F.col("_hash") == F.col("input_hash"), F.col("_intent"))).drop("_hash", "_intent")


def replaced(old: DataFrame, new: DataFrame, key: str = "episode_id") -> DataFrame:
    """Old episodes that no longer exist."""
    return old.join(new.select(key), key, "left_anti")
