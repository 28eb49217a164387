"""Behavioural views over the star-schema test tables: events with entities and counterparties, hourly prices, orders with legs, and point-in-time series.

Each view exists twice, as a DataFrame and as the text of a DuckDB common table expression, so that queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chains by position, and the action of each kind of event.
CHAINS = ("eth", "bsc", "arb", "op", "base")
ACTIONS = {"purchase": "TRANSFER_IN", "click": "TRANSFER_OUT", "view": "DEFI_INTERACTION_BIDIRECTIONAL", "signup": "CEX_INTERACTION_OUT", "error": "CONTRACT_INTERACTION"}
HORIZONS = (300, 3600, 21600, 86400, 259200)
BTC, ETH = "asset:view", "asset:click"
#: 2024-01-30 00:00 UTC, so that late episodes have horizons in the future.
NOW = 1706572800
STABLE = "usdc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(position, values):
    return F.element_at(F.array(*map(F.lit, values)), position)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, entity_id, wallet, chain, ts, k, action_type, cex_id, project_id, cate_id, usd_value, primary_asset_key, counterparty."""
    raw = table(spark, sf_dir, "events")
    return as_events(raw, raw.agg(F.max("user_id") + 1).first()[0])


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events() of the table read as a stream of files. As a pattern, the path may be a file as well as a folder of files."""
    raw = table(spark, sf_dir, "events")
    return as_events(spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events.parquet*"), raw.agg(F.max("user_id") + 1).first()[0])


def as_events(raw: DataFrame, users: int | None) -> DataFrame:
    """The columns of events() of raw rows; `users` is the number of accounts."""
    raw = raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    action = F.lit(None).cast("string")
    for kind, name in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, name).otherwise(action)
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("ent_"), F.col("user_id") % 5).alias("entity_id"), F.concat(F.lit("w"), "user_id").alias("wallet"),
        _pick((F.col("user_id") % 5 + 1).cast("int"), CHAINS).alias("chain"), F.unix_timestamp("ts").alias("ts"), "k", action.alias("action_type"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("cex"), F.col("k") % 3)).alias("cex_id"), F.when(F.col("k") % 4 == 1, F.concat(F.lit("proj"), F.col("k") % 3)).alias("project_id"),
        F.lit(None).cast("string").alias("cate_id"), F.col("value").alias("usd_value"), F.concat(F.lit("asset:"), "event_type").alias("primary_asset_key"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("w"), (F.col("user_id") + 5 * (F.col("k") % 3)) % F.lit(users or 1))).alias("counterparty"),
    )


_ACTION_SQL = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in ACTIONS.items())
EV = f"""ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'ent_' || (user_id % 5) AS entity_id, 'w' || user_id AS wallet, {list(CHAINS)}[CAST(user_id % 5 + 1 AS INT)] AS chain,
  CAST(floor(epoch(ts)) AS BIGINT) AS ts, k, CASE event_type {_ACTION_SQL} END AS action_type, CASE WHEN k % 4 = 0 THEN 'cex' || (k % 3) END AS cex_id,
  CASE WHEN k % 4 = 1 THEN 'proj' || (k % 3) END AS project_id, CAST(NULL AS VARCHAR) AS cate_id, value AS usd_value, 'asset:' || event_type AS primary_asset_key,
  CASE WHEN event_type = 'click' THEN 'w' || ((user_id + 5 * (k % 3)) % (SELECT max(user_id) + 1 FROM events)) END AS counterparty
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_key, ts (start of the hour), resolution, price, status, source."""
    hour = (F.floor(F.unix_timestamp("ts") / 3600) * 3600).cast("long")
    hourly = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("asset:"), "event_type").alias("asset_key"), hour.alias("ts")).agg(F.avg("value").alias("price"))
    return hourly.select("asset_key", "ts", F.lit(3600).alias("resolution"), "price", F.lit("success").alias("status"), F.lit("events").alias("source"))


PX = """px AS (SELECT 'asset:' || event_type AS asset_key, CAST(floor(floor(epoch(ts)) / 3600) * 3600 AS BIGINT) AS ts, 3600 AS resolution, avg(value) AS price, 'success' AS status, 'events' AS source
  FROM events GROUP BY 1, 2)"""


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: event_id, entity_id, wallet, chain, ts, cex_id, project_id, cate_id, owner_nation."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    project = F.when(F.col("o_orderpriority") == "1-URGENT", "bridge_hub").when(F.col("o_orderpriority") == "2-HIGH", "liquidity_pool")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.concat(F.lit("nation_"), "c_nationkey").alias("entity_id"), F.concat(F.lit("c"), "o_custkey").alias("wallet"),
        _pick((F.col("n_regionkey") % 5 + 1).cast("int"), CHAINS).alias("chain"), F.unix_timestamp("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "F", "cex_f").alias("cex_id"),
        project.alias("project_id"), F.lower("o_orderpriority").alias("cate_id"),
    )


ORD = f"""ord AS (SELECT CAST(o_orderkey AS VARCHAR) AS event_id, 'nation_' || c_nationkey AS entity_id, 'c' || o_custkey AS wallet, {list(CHAINS)}[CAST(n_regionkey % 5 + 1 AS INT)] AS chain,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, CASE WHEN o_orderstatus = 'F' THEN 'cex_f' END AS cex_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'bridge_hub' WHEN '2-HIGH' THEN 'liquidity_pool' END AS project_id, lower(o_orderpriority) AS cate_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as legs: event_id, side, pos (order within the event), token_id, amount, price, addr."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    customers = table(spark, sf_dir, "customer").count()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    token = F.when(F.col("l_partkey") % 10 == 0, STABLE).otherwise(F.concat(F.lit("0x"), F.lpad((F.col("l_partkey") % 50).cast("string"), 4, "0")))
    addr = F.when((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 7 == 0), None).otherwise(F.concat(F.lit("c"), (F.col("l_suppkey") * 15) % F.lit(customers or 1)))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("event_id"), F.when(F.col("l_returnflag") == "R", "receive").otherwise("send").alias("side"), F.row_number().over(order).alias("pos"),
        token.alias("token_id"), F.col("l_quantity").alias("amount"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), addr.alias("addr"),
    )


LEGS = f"""legs AS (SELECT CAST(l_orderkey AS VARCHAR) AS event_id, CASE WHEN l_returnflag = 'R' THEN 'receive' ELSE 'send' END AS side,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS pos,
  CASE WHEN l_partkey % 10 = 0 THEN '{STABLE}' ELSE '0x' || lpad(CAST(l_partkey % 50 AS VARCHAR), 4, '0') END AS token_id, l_quantity AS amount, l_extendedprice / l_quantity AS price,
  CASE WHEN NOT (l_linestatus = 'O' AND l_suppkey % 7 = 0) THEN 'c' || ((l_suppkey * 15) % (SELECT count(*) FROM customer)) END AS addr FROM lineitem)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time series in two captured versions: entity_id, kind, chain, time, value, captured_at."""
    ev = events(spark, sf_dir)
    day = (F.floor(F.col("ts") / 86400) * 86400).cast("long")
    daily = ev.groupBy("entity_id", "chain", day.alias("time")).agg(F.round(F.sum("usd_value"), 6).alias("history"), F.count("*").cast("double").alias("flow"), F.round(F.avg("usd_value"), 6).alias("volume"))
    long = daily.selectExpr("entity_id", "chain", "time", "stack(3, 'history', history, 'flow', flow, 'volume', volume) as (kind, value)")
    versions = long.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("captured_at"))
    return versions.select("entity_id", "kind", "chain", "time", (F.col("value") + F.col("captured_at")).alias("value"), "captured_at")


SNAP = """snap AS (SELECT entity_id, kind, chain, time, value + captured_at AS value, captured_at FROM (
  SELECT entity_id, chain, CAST(floor(ts / 86400) * 86400 AS BIGINT) AS time, unnest(['history', 'flow', 'volume']) AS kind,
         unnest([round(sum(usd_value), 6), CAST(count(*) AS DOUBLE), round(avg(usd_value), 6)]) AS value FROM ev GROUP BY 1, 2, 3), (VALUES (0), (1)) v(captured_at))"""
