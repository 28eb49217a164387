"""Reports over aggregates: explorer, ranking, display, evidence, quality and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.windows import cap_per_key

#: Maturity stages, from least to most.
STAGES = ("EARLY", "PROMISING", "ESTABLISHING", "ROBUST")


def rank_score() -> Column:
    """Confidence-aware rank: sample size, effect, hold-out and significance."""
    effect = F.least(F.abs(F.coalesce("shrunk_mean", "mean_return")), F.lit(1.0))
    return F.col("n") / (F.col("n") + 20) * (1 + effect) * (1 + F.coalesce("holdout_accuracy", F.lit(0.0))) * (1 + F.coalesce((F.col("qvalue") <= 0.05).cast("int"), F.lit(0)))


def orders(sort: str) -> list[Column]:
    """Order of a sort name: confidence (default), sample, effect, hit, newest; ties by key."""
    effect = F.abs(F.coalesce("shrunk_mean", "mean_return"))
    hit = F.greatest("negative_count", "positive_count") / F.col("n")
    first = {"sample": [F.desc("n")], "effect": [effect.desc()], "hit": [hit.desc(), F.desc("n")], "newest": [F.desc("updated_ts")]}.get(sort, [rank_score().desc(), F.desc("n")])
    return [*first, F.asc("pattern_key")]


def explore(agg: DataFrame, assets: DataFrame, min_n: int = 3, max_n: int = 0, entity: str | None = None, intent: str | None = None, kind: str | None = None, horizon: int | None = None, search: str | None = None, sort: str = "confidence", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of pattern groups: filters by layer, size, entity, horizon, pattern kind and text (pattern, asset, symbol or name), in one of the orders; pages hold at most 100."""
    out = agg.where(F.col("n") >= min_n)
    out = out.where(F.col("n") <= max_n) if max_n else out
    out = out.where(F.col("intent_label") == intent) if intent else out
    out = out.where(F.col("entity_id") == entity) if entity else out
    out = out.where(F.col("horizon_seconds") == horizon) if horizon else out
    out = out.where(F.col("pattern").startswith(f"{kind}:")) if kind else out
    if search:
        text = search.lower()
        named = assets.where(F.lower("symbol").contains(text) | F.lower("name").contains(text)).select("asset_key").withColumn("_named", F.lit(True)).distinct()
        out = out.join(named, "asset_key", "left").where(F.lower("pattern").contains(text) | F.lower("asset_key").contains(text) | F.coalesce("_named", F.lit(False))).drop("_named")
    return out.orderBy(*orders(sort)).offset(offset).limit(min(limit, 100))


def top_patterns(agg: DataFrame, n: int = 24) -> DataFrame:
    """The dashboard's groups: three or more observations, most mature first, then largest, then of most effect."""
    stage = reduce(lambda acc, s: F.when(F.col("maturity") == s[1], s[0]).otherwise(acc), enumerate(STAGES), F.lit(-1))
    return agg.where("n >= 3").orderBy(stage.desc(), F.desc("n"), F.abs("mean_return").desc(), "pattern_key").limit(n)


def display(agg: DataFrame, assets: DataFrame) -> DataFrame:
    """Rates, direction and asset label (symbol, else the key after its prefix) of each group."""
    named = agg.join(assets.select("asset_key", "symbol"), "asset_key", "left")
    direction = F.when(F.col("mean_return") > 0, "up").when(F.col("mean_return") < 0, "down").otherwise("flat")
    label = F.coalesce("symbol", F.element_at(F.split("asset_key", ":"), -1))
    return named.select("pattern_key", (F.col("negative_count") / F.col("n")).alias("negative_rate"), (F.col("positive_count") / F.col("n")).alias("positive_rate"), direction.alias("direction"), label.alias("asset_label"), F.split_part("asset_key", F.lit(":"), F.lit(1)).alias("asset_chain"))


def pattern_observations(obs: DataFrame, key: str, last: int = 200) -> DataFrame:
    """The latest observations of one group."""
    return obs.where(F.col("pattern_key") == key).orderBy(F.desc("episode_ts"), F.desc("observation_key")).limit(last)


def horizon_profile(obs: DataFrame, by: list[str]) -> DataFrame:
    return obs.groupBy(*by, "horizon_seconds").agg(F.count("*").alias("n"), F.avg("return_value").alias("mean_return"))


def latest_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def episode_evidence(ep: DataFrame, run: DataFrame, from_ts: int, to_ts: int) -> DataFrame:
    """Episodes of a run within its dates."""
    return ep.join(run.select("episode_id").distinct(), "episode_id", "left_semi").where(F.col("start_ts").between(from_ts, to_ts))


def quality_report(ep: DataFrame, states: DataFrame, coverage: DataFrame, requests: DataFrame) -> DataFrame:
    """Per entity: episodes, without asset, unclassified, unknown, mean confidence, pending and unavailable horizons, wallets covered, span covered, and request success rate."""
    base = ep.groupBy("entity_id").agg(
        F.count("*").alias("n_episodes"), F.count_if(F.col("asset_key").isNull()).alias("n_no_asset"), F.count_if(F.col("intent_label").isNull()).alias("n_unclassified"),
        F.count_if(F.col("intent_label") == "unknown").alias("n_unknown"), F.avg("confidence").alias("mean_confidence"),
    )
    open_ = states.join(ep.select("episode_id", "entity_id"), "episode_id").groupBy("entity_id").agg(F.count_if(F.col("state") == "pending").alias("n_pending"), F.count_if(F.col("state") == "permanently unavailable").alias("n_unavailable"))
    held = coverage.groupBy("entity_id").agg(F.count_if(F.col("state") == "complete").alias("n_complete"), (F.max("covered_to") - F.min("covered_from")).alias("covered_s"))
    asked = requests.groupBy("entity_id").agg(F.avg((F.col("status") < 400).cast("double")).alias("request_success"))
    return base.join(open_, "entity_id", "left").join(held, "entity_id", "left").join(asked, "entity_id", "left")


def run_counters(ev: DataFrame, ep: DataFrame, labels: DataFrame) -> DataFrame:
    """Per entity: events, episodes, classified, distinct (episode, asset, horizon) labels, usable ones."""
    events = ev.groupBy("entity_id").agg(F.count("*").alias("n_events"))
    episodes = ep.groupBy("entity_id").agg(F.count("*").alias("n_episodes"), F.count("intent_label").alias("n_classified"))
    own = labels.join(ep.select("episode_id", "entity_id"), "episode_id").groupBy("entity_id").agg(F.count_distinct("episode_id", "asset_key", "horizon_seconds").alias("n_labels"), F.count_if(F.col("simple_return").isNotNull()).alias("n_usable"))
    return events.join(episodes, "entity_id", "left").join(own, "entity_id", "left").fillna(0)


def backlog(unbuilt: DataFrame, ep: DataFrame, states: DataFrame, labels: DataFrame, obs: DataFrame, due: DataFrame) -> DataFrame:
    """Rows of (stage, n): events not built, episodes not classified, horizons pending, labels not observed, groups due."""
    unseen = labels.where("simple_return is not null").join(obs.select("episode_id", "asset_key", "horizon_seconds").distinct(), ["episode_id", "asset_key", "horizon_seconds"], "left_anti")
    stages = {"unbuilt": unbuilt, "unclassified": ep.where("intent_label is null"), "pending": states.where(F.col("state").isin("pending", "retryable failure")), "unobserved": unseen, "due": due}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()])


def progress(collected: Column, stages: list[Column]) -> Column:
    """Share of a run that is done, at most 0.95."""
    return F.least(F.lit(0.95), 0.05 + 0.45 * collected + 0.1 * sum((F.least(F.lit(1.0), s) for s in stages), F.lit(0.0)))


def top_tokens(legs: DataFrame, k: int = 5) -> DataFrame:
    """wallet, chain, token_id, usd: each account's k tokens of most value; ties go to the one seen first (column seq)."""
    summed = legs.groupBy("wallet", "chain", "token_id").agg(F.round(F.sum("usd"), 4).alias("usd"), F.min("seq").alias("_first"))
    return cap_per_key(summed, "wallet", [F.desc("usd"), F.asc("_first")], k).drop("_first")


def dedupe_provenance(wallets: DataFrame) -> DataFrame:
    """One row per (entity, address), with the least chain."""
    return wallets.groupBy("entity_id", "address").agg(F.min("chain").alias("chain"), F.count("*").alias("n_sources"))


def run_list(runs: DataFrame, members: DataFrame) -> DataFrame:
    counted = members.groupBy("run_id").agg(F.count("*").alias("n_events"))
    return runs.join(counted, "run_id", "left").fillna(0, ["n_events"])


def request_summary(requests: DataFrame) -> DataFrame:
    """Per endpoint: attempts, failures, slowest; failed if the status is 400 or more."""
    return requests.groupBy("endpoint").agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("n_failed"), F.max("seconds").alias("slowest"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
