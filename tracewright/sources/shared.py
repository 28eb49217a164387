"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the setting is absent, a temporary folder in local mode and an error on a cluster, whose executors would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Attribute of a materialized frame that holds its folder.
FOLDER = "_scratch_folder"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back, so that later jobs neither recompute it nor depend on executors that may be lost."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, FOLDER, path)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over spark.sql.shuffle.partitions by keys: before rows multiply, when the rows themselves are few enough for adaptive execution to put them in one or two tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a counted table up to which it is sent to every task.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast in joins if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once what was computed from them has itself been written."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(getattr(df, FOLDER))
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
