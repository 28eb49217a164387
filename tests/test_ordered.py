"""Ranks, carried values, medians and bootstrap intervals, with groups cut into segments, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import asof, incremental, ordered, stats, windows
from tracewright.sources import buckets


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, ties, a null key."""
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "hot", "b", "c", None]), rng.randrange(300), k, rng.choice([-0.5, 0.0, 0.25, rng.random() - 0.4])) for k in range(3000)]
    return spark.createDataFrame(data, "g string, t long, id long, v double").repartition(5), data


def grouped(data):
    out = defaultdict(list)
    for row in data:
        out[row[0]].append(row)
    return out


@pytest.mark.parametrize("part", [10_000, 100])
def test_positions(skewed, part):
    df, data = skewed
    got = {(r.g, r.id): (r["_i"], r["_n"]) for r in ordered.positions(df, ["g"], ["t", "id"], part).collect()}
    want = {}
    for g, members in grouped(data).items():
        for i, row in enumerate(sorted(members, key=lambda r: (r[1], r[2])), 1):
            want[g, row[2]] = (i, len(members))
    assert got == want


def test_a_large_group_is_cut_into_many_segments(skewed):
    df, data = skewed
    placed, cut = ordered.segmented(df, ["g"], "t", 100)
    sizes = {tuple(r[:2]): r[2] for r in placed.groupBy("g", "_seg").count().collect()}
    assert cut and len([k for k in sizes if k[0] == "hot"]) > 100 and max(n for k, n in sizes.items() if k[0] == "hot") < 60


def test_a_known_bound_saves_the_count(skewed):
    placed, cut = ordered.segmented(skewed[0], ["g"], "t", 100, at_most=100)
    assert not cut and placed.select("_seg").distinct().count() == 1


@pytest.mark.parametrize("part", [10_000, 100])
def test_summary_and_holdout(skewed, part):
    df, data = skewed
    got = {r.g: r for r in stats.summary(df, ["g"], "v", part).collect()}
    split = {r.g: r for r in stats.holdout(df, ["g"], "v", ["t", "id"], part=part).collect()}
    for g, members in grouped(data).items():
        v = np.array([r[3] for r in members])
        assert got[g].n == len(v) and got[g].median_return == pytest.approx(np.median(v), abs=1e-12) and got[g].std_return == pytest.approx(np.std(v, ddof=1))
        assert (got[g].negative_count, got[g].positive_count) == (int((v < 0).sum()), int((v > 0).sum()))
        v = np.array([r[3] for r in sorted(members, key=lambda r: (r[1], r[2]))])
        cut = int(len(v) * 0.7)
        right = np.sign(v[cut:]) == (-1 if v[:cut].mean() < 0 else 1)
        assert (split[g].train_n, split[g].test_n) == (cut, len(v) - cut) and split[g].holdout_accuracy == pytest.approx(right.mean()) and split[g].test_mean_return == pytest.approx(v[cut:].mean())


@pytest.mark.parametrize("families", [[], ["f"]])
def test_false_discovery_rates_over_several_ranges(spark, families):
    rng = random.Random(8)
    data = [(k, rng.choice("ab"), rng.choice([None, rng.randrange(60) / 60, rng.random()])) for k in range(2000)]
    df = spark.createDataFrame(data, "k int, f string, p double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.k: r.qvalue for r in stats.bh_qvalues(df, families, "p").collect()}
        ranges = ordered.running(df.groupBy(*families, "p").count(), families, "p", "count", "r").select("_part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert ranges > 2
    for family in "ab" if families else [None]:
        own = [(k, 1.0 if p is None else p) for k, f, p in data if family in (None, f)]
        running = 1.0
        ranked = sorted(own, key=lambda x: x[1])
        for place in range(len(ranked), 0, -1):
            running = min(running, ranked[place - 1][1] * len(ranked) / place)
            assert got[ranked[place - 1][0]] == pytest.approx(running, abs=1e-12)


@pytest.mark.parametrize("part", [10_000, 60])
def test_asof_in_stretches(spark, part):
    rng = random.Random(6)
    left = [(rng.choice(["hot", "hot", "x", None]), rng.choice([rng.randrange(1000), None]), k) for k in range(400)]
    right = [(rng.choice(["hot", "hot", "x"]), rng.randrange(1000), f"r{k:03d}") for k in range(400)]
    a, b = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, v string")
    for direction, equal, first, tolerance in (("backward", True, False, None), ("forward", True, True, None), ("backward", False, False, 5), ("forward", False, False, 3)):
        sign = 1 if direction == "backward" else -1
        got = {r.id: r.match.v if r.match else None for r in asof.asof_join(a, b, ["k"], "t", direction, equal, "v", first, tolerance, part=part).collect()}
        for k, t, i in left:
            fits = [(sign * s, v) for g, s, v in right if t is not None and g == k and (sign * s < sign * t or equal and s == t) and (tolerance is None or abs(s - t) <= tolerance)]
            newest = [v for s, v in fits if s == max(x for x, _ in fits)]
            assert got[i] == ((min(newest) if first else max(newest)) if newest else None), (direction, equal, i)


@pytest.mark.parametrize("part", [10_000, 60])
def test_islands_and_rebuild_spans(spark, part):
    rng = random.Random(1)
    data = [(rng.choice(["e", "e", "e", "f"]), rng.choice("uvw"), rng.randrange(20_000), str(k)) for k in range(700)]
    df = spark.createDataFrame(data, "entity_id string, wallet string, ts long, event_id string")
    want = []
    for g in "ef":
        times = sorted(t for e, _, t, _ in data if e == g)
        start = last = None
        for t in times:
            if last is not None and t - last > 40:
                want.append((g, start - 7, last + 7))
                start = None
            start, last = t if start is None else start, t
        want.append((g, start - 7, last + 7))
    assert rows(windows.islands(df, ["entity_id"], "ts", 40, 7, part)) == sorted(want)
    # Spans of any length, overlapping ones and one inside another.
    spans = [("e", 100, 150), ("e", 120, 9000), ("e", 200, 210), ("f", 19_000, 19_100), ("g", 0, 1 << 40)]
    hit = windows.affected_subsessions(df, spark.createDataFrame(spans, "entity_id string, from_ts long, to_ts long"), ["entity_id", "wallet"], 60, part=part)
    want = set()
    for e in "ef":
        for w in "uvw":
            own = sorted((t, i) for a, b, t, i in data if (a, b) == (e, w))
            runs = []
            for t, i in own:
                if runs and t - runs[-1][-1][0] <= 60:
                    runs[-1].append((t, i))
                else:
                    runs.append([(t, i)])
            want |= {i for run in runs for _, i in run if any(a == e and run[0][0] <= hi and run[-1][0] >= lo for a, lo, hi in spans)}
    assert {r.event_id for r in hit.collect()} == want


def numpy_interval(values, samples, seed=0):
    rng = np.random.default_rng(seed)
    medians = np.concatenate([np.median(rng.choice(values, size=(500, len(values)), replace=True), axis=1) for _ in range(samples // 500)])
    return np.quantile(medians, [0.025, 0.975])


def test_bootstrap_equals_numpy_on_small_groups(spark):
    """Values apart enough that resampled medians are few: with many samples both intervals are the same ranks."""
    groups = {n: [float((7 * k) % n) for k in range(n)] for n in (1, 2, 3, 5, 9, 13)}
    df = spark.createDataFrame([(n, v) for n, values in groups.items() for v in values], "g int, v double").repartition(3)
    got = {r.g: (r.ci_low, r.ci_high) for r in stats.bootstrap_ci(df, ["g"], "v", 60_000).collect()}
    for n, values in groups.items():
        assert got[n] == pytest.approx(numpy_interval(np.array(values), 60_000), abs=1e-9), n


@pytest.mark.parametrize("part", [10_000, 100])
def test_bootstrap_of_large_groups_and_null_keys(skewed, part):
    df, data = skewed
    found = stats.bootstrap_ci(df.unionByName(df.limit(5).withColumn("v", F.lit(None).cast("double"))), ["g"], "v", 2000, part=part)
    got = {r.g: (r.ci_low, r.ci_high) for r in found.collect()}
    for g, members in grouped(data).items():
        assert got[g] == pytest.approx(numpy_interval(np.array([r[3] for r in members]), 4000), abs=0.03)


def test_drawn_ranks_have_the_distribution_of_medians():
    for n in (4, 5):
        every = np.sort(np.array(np.meshgrid(*[np.arange(1, n + 1)] * n)).reshape(n, -1), axis=0)
        low, high = every[(n - 1) // 2], every[n // 2]
        want = {pair: times / n**n for pair, times in zip(*(x.tolist() if x.ndim == 1 else list(map(tuple, x.T.tolist())) for x in np.unique(np.stack([low, high]), axis=1, return_counts=True)), strict=True)}
        a, b, times = stats.drawn_ranks(n, 200_000, 3)
        got = {(x, y): t / 200_000 for x, y, t in zip(a.tolist(), b.tolist(), times.tolist(), strict=True)}
        assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 0.005


def test_refresh_writes_back_what_the_next_one_asks_for(spark):
    rng = random.Random(2)
    obs = [(f"o{k}", f"e{k}", "k" if k < 130 else "few", "ent", "p", "", "a", 300, k, -0.02 + rng.random() / 100) for k in range(136)]
    df = spark.createDataFrame(obs, "observation_key string, episode_id string, pattern_key string, entity_id string, pattern string, intent_label string, asset_key string, horizon_seconds int, episode_ts long, return_value double")
    agg = incremental.aggregate(df).withColumn("last_expensive_n", F.lit(None).cast("long"))
    first = {r.pattern_key: r for r in incremental.refresh_stats(agg, df, samples=300).collect()}
    big, few = first["k"], first["few"]
    values = [o[-1] for o in obs[:130]]
    assert big.last_expensive_n == 130 and few.last_expensive_n is None and few.qvalue == 1 and few.maturity == "EARLY"
    assert big.median_return == pytest.approx(np.median(values)) and big.ci_low <= big.median_return <= big.ci_high < 0
    # All returns fall: the sign test, the interval and the hold-out agree.
    assert big.maturity == "ROBUST" and big.qvalue < 1e-6
    state = spark.createDataFrame([tuple(r) for r in first.values()], incremental.refresh_stats(agg, df, samples=300).schema)
    again = {r.pattern_key: r for r in incremental.refresh_stats(state, df.where("false"), samples=300).collect()}
    assert incremental.due_groups(state).count() == 0 and again["k"].ci_low == big.ci_low and again["k"].maturity == "ROBUST"


def test_checkpoints_have_intervals(spark):
    obs = [(f"o{k:03d}", "k", k, float(k % 7)) for k in range(60)]
    df = spark.createDataFrame(obs, "observation_key string, pattern_key string, episode_ts long, return_value double")
    got = {r.n: r for r in incremental.checkpoints(df).collect()}
    assert sorted(got) == [10, 25, 50] and [got[n].maturity for n in (10, 25, 50)] == ["EARLY", "PROMISING", "PROMISING"]
    for n, r in got.items():
        v = np.array([x[-1] for x in obs[:n]])
        assert r.median_return == np.median(v) and r.ci_low <= r.median_return <= r.ci_high and r.mean_return == pytest.approx(v.mean())


STATE = "k string, n long"


def merge(old, delta):
    return old.unionByName(delta).groupBy("k").agg(F.sum("n").alias("n"))


def test_state_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "state")
    put = lambda pairs, number, **o: buckets.update_state(spark.createDataFrame(pairs, STATE), path, STATE, ["k"], merge, number, 16, **o)
    keys = [(f"k{i}", 1) for i in range(200)]
    assert len(put(keys, 0)) == 16
    stamps = lambda: {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "state").iterdir() if p.is_dir()}
    before = stamps()
    one = put([("k3", 5), ("k3", 2)], 1)
    after = stamps()
    assert len(one) == 1 and {k for k in after if after[k] != before[k]} == {f"bucket={one[0]}"}
    # Once more, as after a failure that came too late to be undone: nothing changes.
    assert put([("k3", 5), ("k3", 2)], 1) == []
    got = dict(rows(buckets.read_state(spark, path, STATE)))
    assert got == {k: n + (7 if k == "k3" else 0) for k, n in keys}


def test_state_of_a_batch_cut_off_between_buckets(spark, tmp_path):
    path = str(tmp_path / "state")
    put = lambda pairs, number: buckets.update_state(spark.createDataFrame(pairs, STATE), path, STATE, ["k"], merge, number, 4)
    put([(f"k{i}", 1) for i in range(40)], 0)
    part = [(f"k{i}", 10) for i in range(40)]
    in_one = rows(spark.createDataFrame(part, STATE).where(F.pmod(F.xxhash64("k"), F.lit(4)) == 2))
    assert put(in_one, 1) == [2]
    assert put(part, 1) == [0, 1, 3]
    assert {n for _, n in rows(buckets.read_state(spark, path, STATE))} == {11}


def test_state_keys_may_vanish(spark, tmp_path):
    path = str(tmp_path / "state")
    drop = lambda old, delta: delta
    buckets.update_state(spark.createDataFrame([("a", 1), ("b", 1)], STATE), path, STATE, ["k"], merge, 0, 1)
    buckets.update_state(spark.createDataFrame([], STATE), path, STATE, ["k"], drop, 1, 1, touched=spark.createDataFrame([("a", 0)], STATE))
    assert rows(buckets.read_state(spark, path, STATE)) == []
    assert rows(buckets.read_state(spark, str(tmp_path / "none"), STATE)) == []
