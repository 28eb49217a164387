"""Statistics of groups whose rows are dealt once, before they multiply."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import backtest, clusters, incremental, market, stats

OBS = "observation_key string, episode_id string, pattern_key string, entity_id string, pattern string, intent_label string, asset_key string, horizon_seconds int, episode_ts long, return_value double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(spark, sizes):
    data = [(f"o{(7 * i) % 1009:04d}{g}", f"e{i}", f"k{g}", "ent", f"p{g}", "", "a", 300, i // 2, ((31 * i + g) % 17 - 6) / 10) for g, n in enumerate(sizes) for i in range(n)]
    return data, spark.createDataFrame(data, OBS).repartition(4, "entity_id", "asset_key", "pattern")


def test_checkpoints_move_dealt_rows_no_more(spark):
    data, df = made(spark, (9, 10, 26, 60, 130))
    found = incremental.checkpoints(df, samples=200, at_most=130)
    # Each value used to be joined with its group's resamples.
    assert plan(found).count("Exchange") == 1
    got = {(r.pattern_key, r.n): r for r in found.collect()}
    assert sorted(got) == sorted((f"k{g}", m) for g, n in enumerate((9, 10, 26, 60, 130)) for m in incremental.MILESTONES if m <= n)
    first = []
    for (key, mark), r in got.items():
        values = [o[-1] for o in sorted((o for o in data if o[2] == key), key=lambda o: (o[8], o[0]))][:mark]
        assert (r.mean_return, r.median_return, r.negative_rate) == pytest.approx((np.mean(values), np.median(values), np.mean(np.array(values) < 0)))
        first += [(key, mark, v) for v in values]
    want = stats.bootstrap_ci(spark.createDataFrame(first, "k string, n int, v double"), ["k", "n"], "v", 200)
    for r in want.collect():
        assert (got[r.k, r.n].ci_low, got[r.k, r.n].ci_high) == pytest.approx((r.ci_low, r.ci_high)), (r.k, r.n)


def test_new_observations_are_the_same_however_dealt(spark):
    ep = spark.createDataFrame([(f"e{i}", f"ent{i % 2}", i, "x", None, ["ACTION:a", f"BIGRAM:{i % 3}"]) for i in range(12)], "episode_id string, entity_id string, start_ts long, asset_key string, intent_label string, patterns array<string>")
    labels = spark.createDataFrame([(f"e{i}", a, h, 0.1 * i if h < 3 else None) for i in range(14) for a in "xy" for h in (1, 2, 3)], "episode_id string, asset_key string, horizon_seconds int, simple_return double")
    seen = labels.where("asset_key = 'y' and horizon_seconds = 2")
    plain, dealt = (sorted(map(tuple, incremental.new_observations(ep, labels, seen, dealt=d).collect())) for d in (False, True))
    assert plain == dealt and len(plain) == 12 * 3 * 2


def test_few_prices_are_looked_up_without_dealing_rows(spark):
    ep = spark.range(50).select(F.col("id").cast("string").alias("episode_id"), F.lit("a").alias("asset_key"), (F.col("id") * 3600).alias("start_ts"))
    px = spark.range(60).select(F.lit("a").alias("asset_key"), (F.col("id") * 3600).alias("ts"), (F.col("id") + 1.0).alias("price"), F.lit("success").alias("status"), F.lit("s").alias("source"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = market.forward_returns(ep, px, (3600, 7200), {"b": "a"})
        assert "Exchange hashpartitioning" not in plan(found)
        assert {(r.episode_id, r.horizon_seconds): r.simple_return for r in found.collect()} == pytest.approx({(str(i), 3600 * k): (i + 1 + k) / (i + 1) - 1 for i in range(50) for k in (1, 2)})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.fixture(scope="module")
def report(spark):
    """Nested observations with two wallets in an episode, two sources, unknown regimes and ties in time."""
    ep = [(f"e{i}", f"ent{i % 2}", [f"w{i % 3}", f"w{i % 4}"], i // 2, "a>b" if i % 2 else "b", ["ACTION:a", f"BIGRAM:{i % 2}"][: 1 + i % 3 % 2], ["buy", None][i % 5 % 2]) for i in range(70)]
    labels = [(f"e{i}", a, h, s, ((37 * i + h) % 23 - 9) / 10 + (s == "t")) for i in range(70) for a in ("x", "y")[: 1 + i % 4 // 3] for h in (1, 2) for s in ("s", "t")[i % 2 * (h == 1) :] if (i + h) % 6]
    regimes = [(f"e{i}", ["unknown", "up", "down"][i % 3]) for i in range(60)]
    frames = (
        spark.createDataFrame(ep, "episode_id string, entity_id string, wallets array<string>, start_ts long, motif string, patterns array<string>, intent_label string"),
        spark.createDataFrame(labels, "episode_id string, asset_key string, horizon_seconds int, source string, simple_return double"), spark.createDataFrame(regimes, "episode_id string, regime string"),
    )
    return backtest.nested(*frames), backtest.observations(*frames)


def by_key(rows):
    out = {}
    for r in rows:
        r = r.asDict()
        key = tuple(r.pop(c) for c in backtest.GROUP)
        assert key not in out
        out[key] = r
    return out


def test_nested_observations_are_the_flat_ones(report):
    whole, flat = report
    columns = ["episode_id", "entity_id", "asset_key", "horizon_seconds", "simple_return", "intent_label", "regime"]
    assert sorted(map(tuple, backtest.flat(whole).select(*columns).collect())) == sorted(map(tuple, flat.select(*columns).collect()))


def test_statistics_of_clusters_are_those_of_each_level(report):
    """The rows of all levels used to be shuffled once for every statistic."""
    whole, flat = report
    found = backtest._named_levels(clusters.statistics(whole, 3, samples=100))
    assert plan(found).count("Exchange") == 2
    got, want = by_key(found.collect()), by_key(backtest._by_level(flat, 3, 100).collect())
    assert set(got) == set(want) and len(got) > 50
    for key, row in want.items():
        assert row == pytest.approx(got[key], abs=1e-9), key


def test_holdouts_of_every_group(report, monkeypatch):
    whole, _ = report
    got = by_key(backtest.holdouts(whole).collect())
    monkeypatch.setattr(clusters, "fit", lambda *_: False)
    want = by_key(backtest.holdouts(whole).collect())
    assert set(got) == set(want)
    for key, row in want.items():
        assert row == pytest.approx({c: got[key][c] for c in row}, abs=1e-9), key


def test_clusters_are_cut_nowhere(report, monkeypatch):
    """Batches smaller than clusters, and tables that end inside one."""
    names = ["scope_id", "entity_id", "asset_key", "kind", "pattern"]
    items = clusters.entity_items(report[0]).sort(*names, "start_ts", "episode_id").select(*names, "intent_label", "regime", "returns")
    table = items.toArrow()
    measure, _ = clusters._statistics(1, True, 20, 42, 0.7, names, clusters.ENTITY)
    whole = sorted(map(repr, (r for b in measure(iter(table.to_batches())) for r in b.to_pylist())))
    for together in (1, 7, 40):
        monkeypatch.setattr(clusters, "TOGETHER", together)
        assert sorted(map(repr, (r for b in measure(iter(table.to_batches(max_chunksize=3))) for r in b.to_pylist()))) == whole


def test_mixed_assets_are_those_of_exploded_levels(report):
    whole, flat = report
    found = backtest.mixed_assets(whole)
    assert plan(found).count("Exchange") == 2
    keys = ["level", "scope_id", "pattern", "intent_label", "horizon_seconds"]
    got, want = (sorted(map(tuple, df.select(*keys, "assets").collect())) for df in (found, backtest.single_asset(backtest.levels(flat), keys)))
    assert got == want and len(got) > 20


def test_refresh_moves_dealt_rows_no_more(spark, monkeypatch):
    """Rows of due groups used to be written and then shuffled for each statistic."""
    _, df = made(spark, (4, 10, 26, 61))
    assert plan(incremental._measured(df, 50)).count("Exchange") == 1
    agg = incremental.aggregate(df).withColumn("last_expensive_n", F.when(F.col("pattern_key") == "k2", 26).cast("long"))
    prior = df.groupBy(*incremental.SCOPE).agg(F.avg("return_value").alias("_prior"))
    fast = {r.pattern_key: r.asDict() for r in incremental.refresh_stats(agg, df, samples=50, at_most=61).collect()}
    given = {r.pattern_key: r.asDict() for r in incremental.refresh_stats(agg, df, samples=50, prior=prior).collect()}
    monkeypatch.setattr(incremental, "HELD", 0)
    monkeypatch.setattr(incremental, "BROADCAST_ROWS", 0)
    wide = {r.pattern_key: r.asDict() for r in incremental.refresh_stats(agg, df, samples=50).collect()}
    assert set(fast) == set(wide) == set(given) == {"k0", "k1", "k2", "k3"}
    assert [fast[k]["last_expensive_n"] for k in sorted(fast)] == [None, 10, 26, 61] and fast["k3"]["ci_low"] is not None
    for key, row in wide.items():
        assert row == pytest.approx(fast[key], abs=1e-9), key
    # This prior counts an episode of several groups once for each.
    assert {k: {c: v for c, v in r.items() if c != "shrunk_mean"} for k, r in given.items()} == {k: {c: v for c, v in r.items() if c != "shrunk_mean"} for k, r in fast.items()}
