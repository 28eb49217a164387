"""Hand cases with known results."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import normalize as N
from tracewright.functions import patterns as P
from tracewright.operators import asof, episodes, graph, incremental, intent, market, stats, windows

EV = "event_id string, entity_id string, wallet string, chain string, ts long, action_type string, cex_id string, project_id string, cate_id string, usd_value double, primary_asset_key string, counterparty string"


def event(k, ts, wallet="0xa", counterparty=None, entity="e"):
    return (str(k), entity, wallet, "eth", ts, "SWAP", None, None, None, 1.0, "a:x", counterparty)


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("times, starts", [([0, 10000, 20000, 30000], [0, 0, 0, 30000]), ([0, 21600, 21601], [0, 0, 21601]), ([5, 5], [5, 5]), ([0, 21600, 43200, 64800, 86400], [0, 0, 43200, 43200, 86400])])
def test_windows_are_anchored(spark, times, starts):
    df = spark.createDataFrame([event(k, t) for k, t in enumerate(times)], EV)
    assert [r[1] for r in values(windows.anchored_windows(df, ["entity_id", "wallet"], 21600), "event_id", "window_start")] == starts


def test_windows_match_a_scan_in_any_order(spark):
    import random

    rng = random.Random(1)
    rows = [event(k, rng.randrange(0, 400), rng.choice("ab")) for k in range(300)]
    want = set()
    for wallet in "ab":
        start = None
        for ts in sorted({r[4] for r in rows if r[2] == wallet}):
            if start is None or ts - start > 20:
                start = ts
            want.add((wallet, ts, start))
    for _ in range(2):
        rng.shuffle(rows)
        got = windows.anchored_windows(spark.createDataFrame(rows, EV).repartition(3), ["entity_id", "wallet"], 20)
        assert set(values(got, "wallet", "ts", "window_start")) == want


def test_own_account_link_joins_two_wallets(spark):
    df = spark.createDataFrame([event(1, 1000, "0xa", "0xb"), event(2, 1200, "0xb"), event(3, 1000, "0xc", "0xz")], EV)
    got = episodes.build_episodes(df, 21600)
    assert sorted(tuple(r[0]) for r in got.select("wallets").collect()) == [("0xa", "0xb"), ("0xc",)]


def test_link_tie_goes_to_the_later_event(spark):
    df = spark.createDataFrame([event(1, 1000, "0xa", "0xb"), event(2, 900, "0xb"), event(3, 1100, "0xb")], EV)
    assert values(episodes.nearest_links(df, 100), "event_id", "linked_event_id") == [("1", "3")]


def test_long_components_are_cut(spark):
    df = spark.createDataFrame([event(f"{k:03d}", k) for k in range(120)], EV)
    assert sorted(r[0] for r in episodes.build_episodes(df, 21600, 50, cross_links=False).select("n_events").collect()) == [20, 50, 50]


@pytest.mark.parametrize("tokens, want", [(["A", "B"], ["ACTION:A", "ACTION:B", "BIGRAM:A>B"]), (["A", "B", "C"], ["ACTION:A", "ACTION:B", "ACTION:C", "BIGRAM:A>B", "BIGRAM:B>C", "ENDPOINT:A>C", "TRIGRAM:A>B>C"]), ([], [])])
def test_patterns(spark, tokens, want):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(P.patterns(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("n, full", [(3, False), (4, True), (6, True), (7, False)])
def test_full_pattern_lengths(spark, n, full):
    df = spark.createDataFrame([([f"T{k}" for k in range(n)],)], "t array<string>")
    assert any(p.startswith("FULL:") for p in df.select(P.patterns(F.col("t"))).first()[0]) == full


def test_canonical_patterns(spark):
    df = spark.createDataFrame([(["FULL:A>B", "BIGRAM:A>B"], "A>B"), (None, "A>B>C>D"), (["ENDPOINT:A>B"], "A>B")], "p array<string>, m string")
    assert [r[0] for r in df.select(P.canonical_patterns(F.col("p"), F.col("m"))).collect()] == [["BIGRAM:A>B"], ["FULL:A>B>C>D"], ["BIGRAM:A>B"]]


def test_outflow_to_an_exchange(spark):
    row = spark.createDataFrame([("binance",)], "cex string").select(N.action_class(F.lit(None).cast("string"), F.col("cex"), F.lit(None).cast("string"), F.lit(True), F.lit(False)), N.leg_usd(F.lit(2.0), F.lit(100.0))).first()
    assert tuple(row) == ("CEX_INTERACTION_OUT", 200.0)


@pytest.mark.parametrize("value, want", [("1700000000", 1700000000), ("1700000000000", 1700000000), ("2023-11-14T22:13:20Z", 1700000000), ("n/a", None), (None, None)])
def test_times(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(N.parse_epoch(F.col("v"))).first()[0] == want


LEGS = "event_id string, side string, pos int, token_id string, amount double, price double, addr string"
USDC = "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48"
OTHER = "0x1111111111111111111111111111111111111111"
CASES = [
    ([("send", USDC, None), ("receive", "eth", None)], "ASSET_EXCHANGE_LIKE", None, None, ["0xa"], "buy"),
    ([("send", "eth", None), ("receive", USDC, None)], "ASSET_EXCHANGE_LIKE", None, None, ["0xa"], "sell"),
    ([("receive", "eth", "0xcex")], "CEX_INTERACTION_IN", None, None, ["0xa"], "accumulation"),
    ([("send", "eth", "0x1"), ("send", "eth", "0x2")], "TRANSFER_OUT", None, None, ["0xa"], "distribution"),
    ([("send", "eth", "0xb")], "TRANSFER_OUT", None, None, ["0xa", "0xb"], "internal_rebalance"),
    ([("send", "eth", None), ("receive", "eth", None)], "ASSET_EXCHANGE_LIKE", None, None, ["0xa"], "inventory_rebalance"),
    ([("send", "eth", None), ("receive", OTHER, None)], "ASSET_EXCHANGE_LIKE", None, None, ["0xa"], "asset_rotation"),
    ([("send", "eth", None)], "DEFI_INTERACTION_OUT", "stargate", None, ["0xa"], "bridge_reposition"),
    ([("send", "eth", None)], "LP_ADD", None, "liquidity_pool", ["0xa"], "liquidity_management"),
    ([], "CONTRACT_INTERACTION", None, None, ["0xa"], "unknown"),
]


@pytest.mark.parametrize("sides, action, project, cate, owned, label", CASES)
def test_intent_cases(spark, sides, action, project, cate, owned, label):
    ev = spark.createDataFrame([("p", "e", "1", "eth", "0xa", action, project, cate)], "episode_id string, entity_id string, event_id string, chain string, wallet string, action_type string, project_id string, cate_id string")
    legs = spark.createDataFrame([("1", side, k, token, 1.0, 100.0, addr) for k, (side, token, addr) in enumerate(sides)], LEGS)
    accounts = spark.createDataFrame([("e", a) for a in owned], "entity_id string, address string")
    assert intent.classify(intent.intent_features(ev, legs, accounts)).first()["intent_label"] == label


def test_returns_regimes_and_volatility(spark):
    ep = spark.createDataFrame([("p", "a", 86400)], "episode_id string, asset_key string, start_ts long")
    points = [("a", 86400, 100.0), ("a", 90000, 110.0), *[("btc", 21600 * k, 100.0 + k) for k in range(5)]]
    px = spark.createDataFrame([(*p, "success", "s") for p in points], "asset_key string, ts long, price double, status string, source string")
    label = market.forward_returns(ep, px, (3600,), {"btc": "btc"}).first()
    assert round(label["simple_return"], 9) == 0.1 and label["excess_vs_btc"] is None
    context = market.pre_event_context(ep, px, {"btc": "btc"}).first()
    logs = [math.log((101 + k) / (100 + k)) for k in range(4)]
    mean = sum(logs) / 4
    assert context["regime"] == "risk_on" and math.isclose(context["btc_vol"], math.sqrt(sum((x - mean) ** 2 for x in logs) / 4))
    rates = spark.createDataFrame([(0.03,), (-0.03,), (0.0,), (None,)], "r double").select(market.regime(F.col("r"))).collect()
    assert [r[0] for r in rates] == ["risk_on", "risk_off", "neutral", "unknown"]


def test_third_failure_is_final(spark):
    labels = spark.createDataFrame([("p", "a", 0, 300, None)], "episode_id string, asset_key string, start_ts long, horizon_seconds int, simple_return double")
    old = None
    for want in ("retryable failure", "retryable failure", "permanently unavailable"):
        old = market.horizon_states(labels, 1000, old)
        assert old.first()["state"] == want


@pytest.mark.parametrize("neg, pos", [(0, 0), (0, 5), (6, 0), (3, 7), (10, 10), (400, 600)])
def test_sign_test(spark, neg, pos):
    n, k = neg + pos, min(neg, pos)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    got = spark.createDataFrame([(neg, pos)], "a long, b long").select(stats.sign_test(F.col("a"), F.col("b"))).first()[0]
    assert math.isclose(got, want, rel_tol=1e-9)


def test_false_discovery_rate(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04, None]
    got = stats.bh_qvalues(spark.createDataFrame([(k, 1, x) for k, x in enumerate(p)], "k int, f int, p double"), ["f"], "p")
    filled = [1.0 if x is None else x for x in p]
    want = [min(min(1.0, q * len(p) / sum(y <= q for y in filled)) for q in filled if q >= x) for x in filled]
    assert [round(q, 12) for _, q in values(got, "k", "qvalue")] == [round(q, 12) for q in want]


@pytest.mark.parametrize("args, want", [((3, -0.1, 0.2, 0.01, 0.9, 1.0, 1.0), "EARLY"), ((120, -0.04, -0.01, 0.01, 0.7, -0.02, -0.03), "ROBUST"), ((60, 0.01, 0.02, 0.2, 0.56, 0.1, 0.1), "ESTABLISHING"), ((60, -0.01, 0.02, 0.2, 0.9, 0.1, 0.1), "PROMISING")])
def test_maturity(spark, args, want):
    df = spark.createDataFrame([args], "n int, a double, b double, q double, h double, t double, s double")
    assert df.select(incremental.maturity(*map(F.col, df.columns))).first()[0] == want


@pytest.mark.parametrize("n, last, due", [(9, None, False), (10, None, True), (11, 10, False), (12, 10, True), (110, 100, True), (109, 100, False)])
def test_refresh_trigger(spark, n, last, due):
    df = spark.createDataFrame([(n, last)], "n long, last_expensive_n long")
    assert (incremental.due_groups(df).count() == 1) == due


def test_components_of_a_chain_a_hub_and_nothing(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 1)]
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3))
    assert values(got, "node", "component") == sorted([(k, 0) for k in range(201)] + [(k, 1000) for k in range(1000, 1100)])
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_asof_directions(spark):
    left = spark.createDataFrame([("k", t) for t in (0, 5, 10)], "k string, t long")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 5, "b"), ("k", 8, "c")], "k string, t long, v string")
    pick = lambda **o: [m[1].v if m[1] else None for m in sorted((r.t, r.match) for r in asof.asof_join(left, right, ["k"], "t", tie="v", **o).collect())]
    assert pick() == [None, "b", "c"] and pick(first_tie=True) == [None, "a", "c"]
    assert pick(direction="forward", first_tie=True) == ["a", "a", None] and pick(equal=False) == [None, None, "c"]
    assert pick(tolerance=1) == [None, "b", None]


def test_dirty_rebuild_equals_full(spark):
    import random

    rng = random.Random(2)
    rows = [event(k, rng.randrange(0, 3000), rng.choice("abc")) for k in range(150)]
    df = spark.createDataFrame(rows, EV)
    full = windows.anchored_windows(df, ["entity_id", "wallet"], 30)
    hit = windows.affected_subsessions(df, windows.dirty_windows(df.where("event_id in ('3', '77')"), 30), ["entity_id", "wallet"], 30)
    again = windows.anchored_windows(hit, ["entity_id", "wallet"], 30)
    assert set(values(again, "event_id", "window_start")) <= set(values(full, "event_id", "window_start")) and again.count() > 0


def test_merge_equals_one_pass_for_any_split(spark):
    obs = [("k", "e", "p", "", "a", 300, float(k % 5 - 2)) for k in range(40)]
    df = spark.createDataFrame(obs, "pattern_key string, entity_id string, pattern string, intent_label string, asset_key string, horizon_seconds int, return_value double")
    whole = incremental.aggregate(df).first()
    for cut in itertools.islice((3, 20, 39), 3):
        first, rest = (spark.createDataFrame(part, df.schema) for part in (obs[:cut], obs[cut:]))
        merged = incremental.merge_aggregates(incremental.aggregate(first), incremental.aggregate(rest)).first()
        assert [merged[c] for c in incremental.SUMS] == [whole[c] for c in incremental.SUMS]
