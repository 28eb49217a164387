"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.sources.shared import discard, materialize, scratch, shared_dir

__all__ = ["discard", "frugal", "materialize", "running_total", "scratch", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this Python worker keeps for the next tasks of its stage.
KEPT: dict[Any, Any] = {}
_stage: int | None = None


def _begin() -> None:
    """Drops what was kept for another stage: workers outlive stages, and an executor would hold it beside the memory of the next one."""
    global _stage
    context = TaskContext.get()
    if context is not None and context.stageId() != _stage:
        KEPT.clear()
        _stage = context.stageId()


def _end() -> None:
    """Returns what Arrow has freed but still holds."""
    pa.default_memory_pool().release_unused()


def frugal(compute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """compute, for mapInArrow, with the worker's memory given back: what other stages kept before the first batch, Arrow's free memory after the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        yield from compute(batches)
        _end()

    return run


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows that sort before this one by `order`.

    `df` should be narrow and already materialized. Rows are range-partitioned, so no task sees more than its range;
    only one total per range goes through the window without a key.
    """
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(F.broadcast(totals), "_part").withColumn(out, F.col("_base") + F.col("_local")).drop("_part", "_base", "_local")
