import time

from pyspark.sql import functions as F

from tracewright.operators import incremental as I
from tracewright.operators.windows import anchored_windows
from tracewright.plans import statistics as T
from tracewright.sources import fixtures as X
from tracewright.sources.buckets import read_state
from tracewright.streaming import jobs


def drops(df, path, key="event_id", parts=4):
    for k in range(parts):
        df.where(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(str(path))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_rates_equal_the_batch(spark, sf_dir, tmp_path):
    ev = X.events(spark, sf_dir)
    drops(ev.unionByName(ev.where("k < 20")), tmp_path / "in")
    stream = jobs.stream_rates(jobs.stream_events(spark, str(tmp_path / "in"), lateness="60 days"), "1 day", "12 hours")
    query = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    batch = jobs.stream_rates(ev.withColumn("event_time", F.timestamp_seconds("ts")), "1 day", "12 hours")
    cut = lambda df: df.select("entity_id", "from_ts", "n", F.round("usd", 4))
    assert rows(cut(spark.table("rates"))) == rows(cut(batch))


def test_landing_keeps_late_rows_apart(spark, sf_dir, tmp_path):
    ev = X.events(spark, sf_dir)
    middle = ev.approxQuantile("ts", [0.5], 0)[0]
    for k, part in enumerate((ev.where(F.col("ts") >= middle), ev.where(F.col("ts") < middle))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={k}"))
    query = jobs.land_with_late_rows(jobs.stream_events(spark, str(tmp_path / "in"), lateness="60 days"), str(tmp_path / "silver"), str(tmp_path / "late"), str(tmp_path / "cp"), 86400)
    query.awaitTermination()
    landed = spark.read.parquet(str(tmp_path / "silver"))
    assert landed.count() == ev.count() and landed.select("batch").distinct().count() == 2
    late = spark.read.parquet(str(tmp_path / "late"))
    assert 0 < late.count() < ev.count()


def slices(ev, path, cuts):
    """Files by time, in order of their writing."""
    for low, high in zip([0, *cuts], [*cuts, 1 << 40], strict=True):
        ev.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)


def windows(ev, gap):
    return anchored_windows(ev, ["entity_id", "wallet"], gap).groupBy("entity_id", "wallet", "window_start").agg(F.max("ts").alias("end_ts"), F.count("*").alias("n"))


def test_windows_close_once_and_their_state_ends(spark, sf_dir, tmp_path):
    ev = X.events(spark, sf_dir)
    slices(ev, tmp_path / "in", ev.approxQuantile("ts", [0.3, 0.6], 0))
    # Long after the last event: the watermark passes everything before it.
    last = ev.agg(F.max("ts")).first()[0]
    end = ev.limit(1).withColumns({"ts": F.lit(last + 40 * 86400), "wallet": F.lit("end"), "event_id": F.lit("end")})
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_windows(jobs.stream_events(spark, str(tmp_path / "in"), lateness="3 days"), 21600)
    query = jobs.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    states = [sum(s["numRowsTotal"] for s in p["stateOperators"] if "transformWithState" in s["operatorName"]) for p in query.recentProgress]
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("entity_id", "wallet", "window_start", "end_ts", "n")) == rows(windows(ev, 21600))
    # What is left belongs to the one account that is still open.
    assert max(states) > 20 and states[-1] < 5


def test_kept_windows_take_late_rows_in(spark, sf_dir, tmp_path):
    ev = X.events(spark, sf_dir)
    middle = ev.approxQuantile("ts", [0.5], 0)[0]
    late = (F.crc32("event_id") % 9 == 0) & (F.col("ts") < middle)
    ev.where((F.col("ts") < middle) & ~late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    time.sleep(1.1)
    ev.where(F.col("ts") >= middle).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    time.sleep(1.1)
    ev.where(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    silver, aside, path = (str(tmp_path / x) for x in ("silver", "late", "windows"))
    stream = jobs.stream_events(spark, str(tmp_path / "in"), lateness="60 days")
    jobs.keep_windows(stream, silver, aside, path, str(tmp_path / "cp"), 86400, 21600, 8).awaitTermination()
    kept = lambda: rows(read_state(spark, path, jobs.WINDOW).select("entity_id", "wallet", "window_start", "end_ts", "n"))
    assert kept() == rows(windows(ev, 21600))
    assert spark.read.parquet(aside).where("number = 2").count() > 0
    # The last batch once more changes nothing, and a batch with a new number rebuilds to the same.
    assert jobs.rebuild_windows(ev.where(late), silver, path, 21600, 2, 8) == []
    jobs.rebuild_windows(ev.where(late), silver, path, 21600, 3, 8)
    assert kept() == rows(windows(ev, 21600))


def test_kept_aggregates_equal_the_batch(spark, sf_dir, tmp_path):
    obs = T._new(spark, sf_dir)
    drops(obs, tmp_path / "in", "observation_key", 3)
    source = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "agg")
    jobs.keep_aggregates(source, path, str(tmp_path / "cp"), 8).awaitTermination()
    cut = lambda df: df.select("pattern_key", "n", F.round("sum_return", 6), "negative_count", "positive_count")
    assert rows(cut(read_state(spark, path, jobs.STATE))) == rows(cut(I.aggregate(obs)))
