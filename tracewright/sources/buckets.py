"""Keyed state in fixed buckets, of which a batch rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.shared import discard, materialize, path_exists

#: Buckets of a state table. A table keeps the number that it was begun with.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a state table; none where there is no table yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _stored(spark, path, schema).where("not _mark").drop("_mark", "_batch", "bucket")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _mark boolean, _batch long, bucket int").parquet(path)


def update_state(
    delta: DataFrame, path: str, schema: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], number: int, buckets: int = BUCKETS, touched: DataFrame | None = None
) -> list[int]:
    """Merges batch `number` into the state at `path`, and returns the buckets it rewrote.

    merge(old, delta) gives the new rows of the buckets that hold the keys of delta, or of `touched` where keys may vanish; all other buckets stay as they are. Each bucket records the last batch in it,
    and a bucket that has this batch already is left alone: a batch that was cut off between buckets is simply run again. `keys` must decide which rows merge() puts together. One writer at a time.
    """
    spark = delta.sparkSession
    hit = (delta if touched is None else touched).select(_bucket(keys, buckets).alias("bucket")).distinct()
    wanted = sorted(row[0] for row in hit.collect())
    there = path_exists(spark, path)
    if there and wanted:
        done = _stored(spark, path, schema).where(F.col("_mark") & F.col("bucket").isin(wanted) & (F.col("_batch") >= number)).select("bucket")
        wanted = sorted(set(wanted) - {row[0] for row in done.collect()})
    if not wanted:
        return []
    held = _stored(spark, path, schema) if there else spark.createDataFrame([], f"{schema}, _mark boolean, _batch long, bucket int")
    columns = spark.createDataFrame([], schema).columns
    old = held.where(F.col("bucket").isin(wanted) & ~F.col("_mark")).select(*columns)
    new = merge(old, delta.where(_bucket(keys, buckets).isin(wanted))).select(*columns)
    rows = new.withColumns({"_mark": F.lit(False), "bucket": _bucket(keys, buckets)})
    marks = spark.createDataFrame([(True, b) for b in wanted], "_mark boolean, bucket int")
    # Stored first: the buckets read here are the ones replaced below.
    both = materialize(rows.unionByName(marks, allowMissingColumns=True).withColumn("_batch", F.lit(number).cast("long")), "state-update")
    both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(both)
    return wanted
