"""Ranks, medians and running minima whose groups need not fit a task.

A group of more than PART rows is cut into segments at quantiles of the first column of its order; rows are numbered inside their segment, and the rows of the segments before
are added. Smaller groups are one segment. What is broadcast is a few rows per large group, and of these there are fewer than rows / PART.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.sources.shared import materialize

#: Rows of a group up to which one task sorts it whole.
PART = 2_000_000
#: Segments that a larger group is cut into.
SEGMENTS = 256


def _same(left: str, keys: list[str]) -> Column:
    """Keys equal to their copies under a prefix, nulls included."""
    return F.expr(" AND ".join(f"`{k}` <=> `{left}{k}`" for k in keys))


def _attach(df: DataFrame, small: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with columns of a small table of its keys, which may be null."""
    copy = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *columns)
    return df.join(F.broadcast(copy), _same("_k_", keys), "left").drop(*[f"_k_{k}" for k in keys])


def with_id(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """df and what its rows are dealt and sorted by: its keys if all are numbers, else a 128-bit number of them in two new columns."""
    if not any(isinstance(df.schema[k].dataType, T.StringType) for k in keys):
        return df, keys
    return df.withColumns({"_g1": F.xxhash64(*keys), "_g2": F.xxhash64(F.lit("second"), *keys)}), ["_g1", "_g2"]


def segmented(df: DataFrame, keys: list[str], by: str, part: int = PART, at_most: int | None = None) -> tuple[DataFrame, bool]:
    """df with _seg, the number of a row's segment in order of `by` (nulls first), _before, the rows of its group in earlier ones, and _size, the rows of its group (null for one segment); and whether any group was cut.

    at_most is a bound on the rows of a group, if one is known: within `part`, it saves counting the groups. So does a table that has no more than `part` rows.
    """
    whole = {"_seg": F.lit(0), "_before": F.lit(0).cast("long"), "_size": F.lit(None).cast("long")}
    if (df.count() if at_most is None else at_most) <= part:
        return df.withColumns(whole), False
    large = df.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > part)
    if large.isEmpty():
        return df.withColumns(whole), False
    tagged = _attach(df, materialize(large, "large-groups"), keys, ["_size"])
    cuts = tagged.where(F.col("_size").isNotNull()).groupBy(*keys).agg(F.percentile_approx(by, [k / SEGMENTS for k in range(1, SEGMENTS)], 10_000).alias("_cuts"))
    tagged = _attach(tagged, materialize(cuts, "segment-cuts"), keys, ["_cuts"])
    tagged = tagged.withColumn("_seg", F.when(F.col("_size").isNull(), 0).otherwise(F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(by))), F.lit(0)))).drop("_cuts")
    counts = tagged.where(F.col("_size").isNotNull()).groupBy(*keys, "_seg").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    placed = _attach(tagged, materialize(before, "segment-offsets"), [*keys, "_seg"], ["_before"])
    return placed.withColumn("_before", F.coalesce("_before", F.lit(0))), True


def positions(df: DataFrame, keys: list[str], order: list[str], part: int = PART, at_most: int | None = None) -> DataFrame:
    """df with _i, the number of a row in its group by `order` (from 1, nulls first), and _n, the rows of its group.

    Rows that tie in all of `order` are numbered in no particular order. Only ties in the first column of the order are ever sorted in one task beyond `part` rows.
    """
    placed, cut = segmented(df, keys, order[0], part, at_most)
    whole = Window.partitionBy(*keys, "_seg") if cut else Window.partitionBy(*keys)
    numbered = placed.withColumn("_i", F.row_number().over(whole.orderBy(*order)) + F.col("_before"))
    return numbered.withColumn("_n", F.coalesce("_size", F.count("*").over(whole))).drop("_seg", "_before", "_size")


def is_middle() -> Column:
    """Whether a numbered row (_i of _n) is the middle one, or one of the two in the middle."""
    return (F.col("_i") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_i") == F.ceil((F.col("_n") + 1) / 2))


def running(df: DataFrame, family: list[str], by: str, total: str, out_sum: str) -> DataFrame:
    """df with out_sum, the sum of `total` over the rows of a family up to this one in order of `by`, whose values are distinct within a family; and _part, a range of (family, by) small enough for a task.

    df should be narrow and already stored. Only one total per family and range meets in a window.
    """
    order = [*family, by]
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*family, "_part").agg(F.sum(total).alias("_sum"))
    earlier = Window.partitionBy(*(family or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*family, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*family, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(base, [*family, "_part"]).withColumn(out_sum, F.col("_base") + F.sum(total).over(inside)).drop("_base")


def least_from_here(df: DataFrame, family: list[str], by: str, value: str, out: str) -> DataFrame:
    """df (with _part, as running() leaves it) with `out`, the least `value` in a family among this row and those after it in order of `by`."""
    parts = df.groupBy(*family, "_part").agg(F.min(value).alias("_least"))
    later = Window.partitionBy(*(family or [F.lit(0)])).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    rest = parts.select(*family, "_part", F.min("_least").over(later).alias("_rest"))
    inside = Window.partitionBy(*family, "_part").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(rest, [*family, "_part"]).withColumn(out, F.least(F.min(value).over(inside), "_rest")).drop("_rest", "_part")


def carried(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], how: str = "last", inclusive: bool = True, part: int = PART, at_most: int | None = None) -> DataFrame:
    """df, whose column _t leads its order, with each of `columns` replaced by the last non-null value (how = "last") or the greatest one ("max") of its group up to the row; without the row itself where not inclusive.

    Large groups run through their segments of _t side by side; what a segment ends with is handed to the next ones.
    """
    over = (lambda c, w: F.last(c, ignorenulls=True).over(w)) if how == "last" else (lambda c, w: F.max(c).over(w))
    placed, cut = segmented(df, keys, "_t", part, at_most)
    window = Window.partitionBy(*keys, "_seg").orderBy(*order) if cut else Window.partitionBy(*keys).orderBy(*order)
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    if not cut:
        return placed.withColumns({c: over(c, frame) for c in columns}).drop("_seg", "_before", "_size")
    whole = placed.where(F.col("_size").isNotNull()).withColumns({c: over(c, window.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}).withColumn("_at", F.row_number().over(window))
    ends = whole.groupBy(*keys, "_seg").agg(*[F.max_by(c, "_at").alias(c) for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    handed = materialize(ends.select(*keys, "_seg", *[over(c, earlier).alias(f"_from_{c}") for c in columns]), "segment-ends")
    inside = _attach(placed.withColumns({c: over(c, frame) for c in columns}), handed, [*keys, "_seg"], [f"_from_{c}" for c in columns])
    both = F.coalesce if how == "last" else F.greatest
    return inside.withColumns({c: both(c, f"_from_{c}") for c in columns}).drop("_seg", "_before", "_size", *[f"_from_{c}" for c in columns])
