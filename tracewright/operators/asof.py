"""As-of joins: one pass over the sorted union of both sides instead of a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import ordered


def _known(by: list[str]) -> Column:
    """Whether time and keys are there: a null matches nothing."""
    good = F.col("_t").isNotNull()
    for key in by:
        good &= F.col(key).isNotNull()
    return good


def _typed_null(df: DataFrame, column: Column) -> Column:
    return F.lit(None).cast(df.select(column.alias("c")).schema["c"].dataType)


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str, direction: str = "backward", equal: bool = True, tie: str | None = None, first_tie: bool = False, tolerance: int | None = None,
    out: str = "match", part: int = ordered.PART, at_most: int | None = None,
) -> DataFrame:
    """Adds to every left row the struct `out` of the right row nearest in `on`, a number, among those that agree in `by`.

    direction: "backward" (at or before) or "forward" (at or after); equal=False leaves equal times out. Among right rows of the same time the greatest `tie` wins (the least with
    first_tie). Beyond `tolerance`, and where nothing matches, `out` is null. Null keys or times match nothing. Both sides meet in one sort per key, and only the last match is kept while
    rows stream by; keys of more than `part` rows are cut into stretches of time. at_most, if known, is a bound on the rows of both sides.
    """
    time = F.col(on) if direction == "backward" else -F.col(on)
    payload, held = F.struct(*right.columns), F.struct(*left.columns)
    rank = F.col(tie) if tie else F.lit(0)
    rows = right.where(F.col(on).isNotNull()).select(*by, time.alias("_t"), F.lit(0 if equal else 1).alias("_kind"), payload.alias("_right"), rank.alias("_tie"), _typed_null(left, held).alias("_left"))
    probes = left.select(*by, time.alias("_t"), F.lit(1 if equal else 0).alias("_kind"), _typed_null(right, payload).alias("_right"), _typed_null(right, rank).alias("_tie"), held.alias("_left"))
    order = [F.col("_t").asc(), F.col("_kind"), F.col("_tie").desc() if first_tie else F.col("_tie").asc()]
    seen = ordered.carried(rows.unionByName(probes), by, order, ["_right"], part=part, at_most=at_most).where(F.col("_left").isNotNull())
    good = _known(by)
    if tolerance is not None:
        good &= F.abs(F.col(f"_right.{on}") - F.col(f"_left.{on}")) <= tolerance
    return seen.select("_left.*", F.when(good, F.col("_right")).alias(out))


def asof_kinds(left: DataFrame, points: DataFrame, by: list[str], on: str, kinds: tuple[str, ...], part: int = ordered.PART) -> DataFrame:
    """Adds to every left row, for each kind, the value of the latest of the points (by, kind, `on`, value) at or before it; points of a kind are distinct in (by, on).

    All kinds pass in one sort: a point sets its own kind's column, and each column keeps its last value.
    """
    held = F.struct(*left.columns)
    rows = points.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("_t"), F.lit(0).alias("_kind"), *[F.when(F.col("kind") == k, F.struct("value")).alias(k) for k in kinds], _typed_null(left, held).alias("_left"))
    probes = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_kind"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in kinds], held.alias("_left"))
    seen = ordered.carried(rows.unionByName(probes), by, [F.col("_t"), F.col("_kind")], list(kinds), part=part).where(F.col("_left").isNotNull())
    return seen.select("_left.*", *[F.when(_known(by), F.col(f"{k}.value")).alias(f"ctx_{k}") for k in kinds])


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str, tolerance: int, out: str = "match", part: int = ordered.PART) -> DataFrame:
    """The nearest right row within `tolerance` either way; at equal distance the one at or after wins. At or after, the least tie of the time; before, the greatest."""
    most = left.count() + right.count()
    most = most if most <= part else None
    after = asof_join(left, right, by, on, "forward", True, tie, True, tolerance, "_after", part, most)
    both = asof_join(after, right, by, on, "backward", False, tie, False, tolerance, "_before", part, most)
    ahead, behind = F.col(f"_after.{on}") - F.col(on), F.col(on) - F.col(f"_before.{on}")
    choice = F.when(F.col("_after").isNotNull() & (F.col("_before").isNull() | (ahead <= behind)), F.col("_after")).otherwise(F.col("_before"))
    return both.select(*left.columns, choice.alias(out))
