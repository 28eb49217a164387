"""Connected components by alternating star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.sources.shared import discard, materialize

#: Edges up to which every part of a round fits one task; they are coalesced to it, which saves empty tasks and shuffles.
ONE_TASK = 20_000


def _attach_least(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """Adds m, the least of `other` per `key`: a partial aggregate and a join, so a hub's rows are never gathered in one place."""
    least = pairs.groupBy(key).agg(F.min(other).alias("m"))
    return pairs.join(least, key)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node that an edge joins to another one.

    Nodes are of any orderable type. Self-loops, repeated edges and edges with a null end are ignored; other columns are dropped; no edges give no rows.
    Each round is written to the shared folder and replaces the one before; the number of rounds grows with the logarithm of the longest path, and exceeding max_rounds raises.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        part = now.coalesce(1) if state[0] <= ONE_TASK else now
        both = part.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = _attach_least(both, "u", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _attach_least(large, "u", "v").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = materialize(small.where(F.col("u") != F.col("v")).distinct(), "components")
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
