"""Backtest: observations of returns after patterns, and grouped statistics at several levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import clusters
from tracewright.operators.stats import bh_qvalues, bootstrap_ci, holdout, shrink, sign_test, summary
from tracewright.sources.shared import materialize, small, spread

LEVELS = ("entity_action", "entity_action_intent", "entity_pattern", "entity_pattern_intent", "wallet_pattern_intent_asset")


def observations(ep: DataFrame, labels: DataFrame, context: DataFrame) -> DataFrame:
    """One row per (episode, asset, horizon) with a return: episodes joined to labels and, where known, regimes. Several price sources give the first by name."""
    order = Window.partitionBy("episode_id", "asset_key", "horizon_seconds").orderBy("source", "simple_return")
    single = labels.where("simple_return is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("episode_id", "asset_key", "horizon_seconds", "simple_return")
    joined = ep.drop("asset_key").join(single, "episode_id").join(context.select("episode_id", "regime"), "episode_id", "left")
    return joined.withColumn("intent_label", F.coalesce("intent_label", F.lit("unknown"))).withColumn("regime", F.coalesce("regime", F.lit("unknown")))


def nested(ep: DataFrame, labels: DataFrame, context: DataFrame) -> DataFrame:
    """The same observations, those of an episode and asset in one row: returns is an array of (horizon_seconds, simple_return). Stored, with rows of equal returns near each other."""
    dealt = spread(labels.where("simple_return is not null").select("episode_id", "asset_key", "horizon_seconds", F.struct("source", "simple_return").alias("_s")), "episode_id")
    single = dealt.groupBy("episode_id", "asset_key", "horizon_seconds").agg(F.min("_s").alias("_s"))
    returns = single.groupBy("episode_id", "asset_key").agg(F.collect_list(F.struct("horizon_seconds", F.col("_s.simple_return").alias("simple_return"))).alias("returns"))
    own = ep.select("episode_id", "entity_id", "wallets", "start_ts", "motif", "patterns", F.coalesce("intent_label", F.lit("unknown")).alias("intent_label"))
    joined = own.join(returns, "episode_id").join(context.select("episode_id", "regime"), "episode_id", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))
    return materialize(joined.sortWithinPartitions("asset_key", "start_ts"), "nested-observations")


def flat(obs: DataFrame) -> DataFrame:
    """Rows of nested() as observations() has them."""
    return obs.select("*", F.inline("returns")).drop("returns")


def all_patterns() -> Column:
    """The patterns of an observation, and each of them once more under the regime where that is known."""
    under = F.when(F.col("regime") != "unknown", F.transform("patterns", lambda p: F.concat(F.lit("REGIME:"), F.col("regime"), F.lit("|"), p))).otherwise(F.array().cast("array<string>"))
    return F.array_union("patterns", under)


def explode_patterns(obs: DataFrame) -> DataFrame:
    """A row per pattern, and one more per pattern under the regime where that is known."""
    return obs.withColumn("pattern", F.explode(all_patterns()))


def explode_wallets(df: DataFrame) -> DataFrame:
    return df.withColumn("wallet", F.explode(F.array_distinct("wallets")))


def broad_action(motif):
    """The first token of a motif."""
    return F.split_part(motif, F.lit(">"), F.lit(1))


def levels(obs: DataFrame, code: Callable[[Column], Column] | None = None) -> DataFrame:
    """Observations once for each level's key: level, scope_type, scope_id, entity_id, pattern, intent_label ('' where the level ignores it). ACTION patterns stand for themselves at the level of entity_action.

    With `code`, names are coded before rows multiply: all keys are numbers then (CODED; the level is its place in LEVELS), which decoded() turns back into names.
    """
    put = code or (lambda c: c.cast("string"))
    base = ["episode_id", "start_ts", "entity_id", "asset_key", "horizon_seconds", "simple_return"]
    every = F.coalesce(all_patterns(), F.array().cast("array<string>"))
    names = {c: put(F.col(c)) for c in ("entity_id", "asset_key", "intent_label")}
    one = obs.select(
        *[names[c].alias(c) if c in names else c for c in base], names["intent_label"].alias("intent_label"), put(broad_action(F.col("motif"))).alias("action"), F.transform(F.array_distinct("wallets"), lambda w: put(w)).alias("wallets"),
        F.transform(F.filter(every, lambda p: ~p.startswith("ACTION:")), lambda p: put(p)).alias("own"), F.transform(F.filter(every, lambda p: p.startswith("ACTION:")), lambda p: put(p)).alias("short"),
    )
    carried = [*base, "intent_label"]

    def rows(source: DataFrame, who: str, pattern: str, *kinds: int) -> DataFrame:
        each = source.select(*base, F.col(who).alias("scope_id"), F.col(pattern).alias("pattern"), "intent_label", F.explode(F.array(*map(F.lit, kinds))).alias("_level"))
        return each.withColumn("intent_label", F.when(F.col("_level").isin(0, 2), put(F.lit(""))).otherwise(F.col("intent_label")))

    own, short = (one.select(*carried, F.explode(c).alias("pattern")) for c in ("own", "short"))
    both = one.select(*carried, "wallets", F.explode(F.concat("own", "short")).alias("pattern")).select(*carried, "pattern", F.explode("wallets").alias("wallet"))
    found = rows(one, "entity_id", "action", 0, 1).unionByName(rows(own, "entity_id", "pattern", 2, 3)).unionByName(rows(short, "entity_id", "pattern", 3)).unionByName(rows(both, "wallet", "pattern", 4))
    return found if code else _named_levels(found)


def _named_levels(df: DataFrame) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_level") + 1)
    return df.select("*", level.alias("level"), F.when(F.col("_level") == 4, "wallet").otherwise("entity").alias("scope_type")).drop("_level")


#: Keys of coded levels.
CODED = ["_level", "scope_id", "entity_id", "pattern", "intent_label", "asset_key", "horizon_seconds"]


def decoded(df: DataFrame, obs: DataFrame) -> DataFrame:
    """Rows keyed by CODED with names again, those of obs: GROUP and the other columns."""
    single = obs.select(F.explode(F.array("entity_id", "asset_key", "intent_label", F.lit(""), broad_action(F.col("motif")))).alias("name")).distinct()
    many = obs.select(F.coalesce(all_patterns(), F.array().cast("array<string>")).alias("p"), "wallets").distinct().select(F.explode(F.concat("p", F.coalesce("wallets", F.array().cast("array<string>")))).alias("name"))
    names = materialize(single.unionByName(many).distinct().select(F.xxhash64("name").alias("_code"), "name"), "names")
    for column in CODED[1:-1]:
        df = df.join(names.select(F.col("_code").alias(column), F.col("name").alias(f"_{column}")), column).withColumn(column, F.col(f"_{column}")).drop(f"_{column}")
    return _named_levels(df)


def largest_group(obs: DataFrame) -> int:
    """No level has a group of more rows: an observation is at most once in a group, and groups mix neither entities nor assets nor horizons."""
    return obs.groupBy("entity_id", "asset_key", "horizon_seconds").count().agg(F.max("count")).first()[0] or 0


GROUP = ["level", "scope_type", "scope_id", "entity_id", "pattern", "intent_label", "asset_key", "horizon_seconds"]


def priors(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean return per (entity, horizon, asset), and per intent as well, before anything is exploded."""
    plain = obs.groupBy("entity_id", "horizon_seconds", "asset_key").agg(F.avg("simple_return").alias("prior"))
    by_intent = obs.groupBy("entity_id", "intent_label", "horizon_seconds", "asset_key").agg(F.avg("simple_return").alias("prior"))
    return plain, by_intent


def single_asset(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that mix assets; an estimate never may."""
    return obs.groupBy(*keys).agg(F.count_distinct("asset_key").alias("assets")).where("assets > 1")


def backtest(ep: DataFrame, labels: DataFrame, context: DataFrame, min_n: int = 5, strength: float = 20.0, samples: int = 2000) -> DataFrame:
    """Statistics of every group at every level with at least min_n observations, keyed by motif = level:pattern.

    The prior is the mean return of the entity's observations of that asset and horizon (and intent, at the levels that have one), else the mean of all. With samples = 0 there are no
    intervals: ci_low and ci_high are null.
    """
    whole = nested(ep, labels, context)
    obs = flat(whole)
    if clusters.fit(whole):
        joined = _named_levels(clusters.statistics(whole, min_n, samples=samples))
    else:
        joined = _by_level(spread(obs, "episode_id"), min_n, samples)
    if not samples:
        joined = joined.withColumns({c: F.lit(None).cast("double") for c in ("ci_low", "ci_high")})
    joined = joined.withColumn("sign_pvalue", sign_test(F.col("negative_count"), F.col("positive_count")))
    plain, by_intent = priors(obs)
    every = obs.agg(F.avg("simple_return")).first()[0]
    plain, by_intent = (small(materialize(p, "priors")) for p in (plain, by_intent))
    joined = joined.join(plain.withColumnRenamed("prior", "_plain"), ["entity_id", "horizon_seconds", "asset_key"], "left").join(by_intent.withColumnRenamed("prior", "_own"), ["entity_id", "intent_label", "horizon_seconds", "asset_key"], "left")
    prior = F.coalesce(F.when(F.col("intent_label") == "", F.col("_plain")).otherwise(F.col("_own")), F.lit(every))
    joined = joined.withColumn("prior_mean", prior).withColumn("shrunk_mean", shrink(F.col("n"), F.col("mean_return"), F.col("prior_mean"), strength)).drop("_plain", "_own")
    rates = {"negative_rate": F.col("negative_count") / F.col("n"), "positive_rate": F.col("positive_count") / F.col("n"), "motif": F.concat_ws(":", "level", "pattern")}
    return bh_qvalues(joined.withColumns(rates), [], "sign_pvalue")


def _by_level(obs: DataFrame, min_n: int, samples: int) -> DataFrame:
    """Statistics of groups of any size, each level's rows dealt and sorted by themselves."""
    obs = materialize(obs, "observations")
    most = largest_group(obs)
    stats = materialize(summary(levels(obs, F.xxhash64), CODED, "simple_return", at_most=most).where(F.col("n") >= min_n), "group-statistics")
    rows = levels(obs, F.xxhash64).join(stats.select(*CODED), CODED, "left_semi")
    joined = stats.join(holdout(rows, CODED, "simple_return", ["start_ts", "episode_id"], at_most=most), CODED)
    if samples:
        joined = joined.join(bootstrap_ci(rows, CODED, "simple_return", samples, at_most=most), CODED, "left")
    return decoded(joined, obs)


def holdouts(obs: DataFrame) -> DataFrame:
    """GROUP and the hold-out of every group at every level, of nested observations."""
    if clusters.fit(obs):
        return _named_levels(clusters.statistics(obs, summary=False))
    rows = materialize(spread(flat(obs), "episode_id"), "observations")
    return decoded(holdout(levels(rows, F.xxhash64), CODED, "simple_return", ["start_ts", "episode_id"], at_most=largest_group(rows)), rows)


def mixed_assets(obs: DataFrame) -> DataFrame:
    """level, scope_id, pattern, intent_label, horizon_seconds, assets: single_asset() of the groups of all levels, of nested observations."""
    keys = ["level", "scope_id", "pattern", "intent_label", "horizon_seconds"]
    return (_named_levels(clusters.mixed_assets(obs)) if clusters.fit(obs, by_asset=False) else single_asset(levels(flat(obs)), keys)).select(*keys, "assets")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The report in display order: most observations first, then the least q."""
    ordered = df.orderBy(F.desc("n"), F.asc_nulls_last("qvalue"))
    ordered.write.option("header", True).csv(path) if kind == "csv" else ordered.write.json(path)
