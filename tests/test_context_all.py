"""Contexts of every event against brute force."""

import bisect

from tracewright.plans import behaviour
from tracewright.sources import fixtures as X


def latest(points, at):
    """The value of the last (time, value) at or before `at`."""
    k = bisect.bisect_right(points, at, key=lambda p: p[0])
    return points[k - 1][1] if k else None


def grouped(rows):
    out = {}
    for key, time, value in rows:
        out.setdefault(key, {})[time] = max(value, out.get(key, {}).get(time, value))
    return {key: sorted(points.items()) for key, points in out.items()}


def test_every_event_has_its_contexts(spark, sf_dir):
    ev = X.events(spark, sf_dir).collect()
    newest = X.series(spark, sf_dir).where("captured_at = 1").collect()
    series = grouped(((r["entity_id"], r["chain"], r["kind"]), r["time"], r["value"]) for r in newest)
    want = {r["event_id"]: tuple(latest(series.get((r["entity_id"], r["chain"], k), []), r["ts"]) for k in behaviour.CONTEXTS) for r in ev}
    got = {r[0]: tuple(r[1:]) for r in behaviour.e12_context_asof(spark, sf_dir).collect()}
    assert len(got) == len(ev)
    for event, values in want.items():
        assert all(a == b or abs(a - b) < 2e-6 for a, b in zip(got[event], values, strict=True)), event


def test_every_event_has_its_wallet_context(spark, sf_dir):
    ev = X.events(spark, sf_dir).collect()
    series = grouped(((r["wallet"], r["chain"]), r["ts"], r["usd_value"]) for r in ev)
    want = {r["event_id"]: latest(series[r["wallet"], r["chain"]], r["ts"] - 3600) for r in ev}
    got = {r["event_id"]: r["history"] for r in behaviour.e13_wallet_context(spark, sf_dir).collect()}
    assert got == want and len(got) == len(ev)
