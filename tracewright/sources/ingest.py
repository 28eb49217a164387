"""Landing raw responses and keeping ledgers: archives, pages, coverage, memberships, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.normalize import STABLE_IDS, action_class, asset_key, event_id, gross_usd, leg_usd, normal_address, whole_seconds
from tracewright.sources.shared import discard, materialize, path_exists


#: Hexadecimal digits of a digest that name its part of the archive's index.
PREFIX = 2


def write_archive(raw: DataFrame, path: str) -> None:
    """Compressed JSON by provider and day, one row per distinct payload (sha256). Payloads that the archive holds already are not written again.

    Digests are kept beside the archive, in parts by their first digits, and a landing reads the parts that its own digests fall in; payloads are not read. A landing's files are named by what is new in it,
    so one that was cut off before its digests were noted overwrites its own files when it is run again. One landing at a time.
    """
    session, index = raw.sparkSession, f"{path.rstrip('/')}_digests"
    first = ["provider", "day", *[c for c in raw.columns if c not in ("provider", "day")]]
    keyed = raw.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.min(F.struct(*first)).alias("_first")).select("sha256", "_first.*", F.substring("sha256", 1, PREFIX).alias("prefix"))
    if path_exists(session, index):
        own = [row[0] for row in keyed.select("prefix").distinct().collect()]
        known = session.read.schema("sha256 string, prefix string").parquet(index).where(F.col("prefix").isin(own))
        keyed = keyed.join(known.select("sha256"), "sha256", "left_anti")
    fresh = materialize(keyed, "landing")
    mark = fresh.agg(F.hex(F.bit_xor(F.xxhash64("sha256"))).alias("mark")).first()[0]
    if mark is not None:
        landed = fresh.drop("prefix").withColumn("landing", F.lit(mark))
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "day", "landing").option("compression", "gzip").json(path)
        fresh.select("sha256", "prefix").repartition("prefix").write.mode("append").partitionBy("prefix").parquet(index)
    discard(fresh)


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def latest_valid(responses: DataFrame, now: int, max_age: int = 3600) -> DataFrame:
    """The newest response per (endpoint, request), if it may be used: status under 400, and fresh or a historical page (cursor over 0).

    Where the newest may not be used there is no row, even if an older response could be.
    """
    newest = Window.partitionBy("endpoint", "request").orderBy(F.desc("fetched_at"), F.desc("response_id"))
    last = responses.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return last.where((F.col("status") < 400) & ((now - F.col("fetched_at") < max_age) | (F.col("cursor") > 0)))


LEG = "array<struct<amount:double, price:double, token_id:string, {other}:string>>"
ROW = (
    "struct<id:string, idx:int, time_at:string, cate_id:string, cex_id:string, project_id:string, other_addr:string, sends:" + LEG.format(other="to_addr") + ", receives:" + LEG.format(other="from_addr")
    + ", tx:struct<id:string, from_addr:string, to_addr:string>, token_approve:string>"
)
NAMES = "map<string, struct<name:string>>"
PAGE = f"history_list array<{ROW}>, cate_dict {NAMES}, cex_dict {NAMES}, project_dict {NAMES}, token_dict map<string, struct<symbol:string, name:string>>"


def page_rows(pages: DataFrame) -> DataFrame:
    """History rows of JSON pages (column payload): the pages' other columns, pos, row, ts, and cate_name, cex_name, project_name looked up in the page's dictionaries; rows without a positive time are dropped."""
    kept = [c for c in pages.columns if c != "payload"]
    each = pages.select(*kept, F.from_json("payload", PAGE).alias("_page")).select(*kept, "_page", F.posexplode("_page.history_list").alias("pos", "row"))
    name = lambda kind: F.try_element_at(f"_page.{kind}_dict", F.coalesce(f"row.{kind}_id", F.lit("")))["name"].alias(f"{kind}_name")
    return each.select(*kept, "pos", "row", whole_seconds(F.col("row.time_at")).alias("ts"), *map(name, ("cate", "cex", "project")), F.col("_page.token_dict").alias("tokens")).where("ts > 0")


def flatten_pages(pages: DataFrame) -> DataFrame:
    """The pages' other columns with id, idx, ts, cex_id and the names of category, exchange and project of each row."""
    kept = [c for c in pages.columns if c != "payload"]
    return page_rows(pages).select(*kept, "row.id", "row.idx", "ts", "row.cex_id", "cate_name", "cex_name", "project_name")


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Events of history pages (entity_id, wallet, chain, payload), in one pass without a shuffle.

    event_id, entity_id, wallet (lower case), chain, tx_hash (of the row, else of its transaction), event_index, ts, action_type, cate_id, cex_id, project_id and their names, other_addr, usd_value (the larger side), primary_token_id,
    primary_asset_key, primary_direction, sends, receives, tx, token_approve, tokens. The primary leg is the most valuable one that is not stable, the first of equals, sends before receives; none if all are worth nothing.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    none = lambda c: F.coalesce(c, F.expr("array()").cast("array<struct<token_id:string, usd:double, direction:string>>"))
    leg = lambda direction: lambda x: F.struct(x["token_id"].alias("token_id"), leg_usd(x["amount"], x["price"]).alias("usd"), F.lit(direction).alias("direction"))
    rows = page_rows(pages).select(
        "*", F.coalesce(filled("row.id"), filled("row.tx.id")).alias("tx_hash"), none(F.transform("row.sends", leg("send"))).alias("_out"), none(F.transform("row.receives", leg("receive"))).alias("_in")
    )
    worth = F.filter(F.concat("_out", "_in"), lambda x: ~F.lower(F.coalesce(x["token_id"], F.lit(""))).isin(*STABLE_IDS))
    start = F.struct(F.lit(None).cast("string").alias("token_id"), F.lit(0.0).alias("usd"), F.lit(None).cast("string").alias("direction"))
    best = F.aggregate(worth, start, lambda held, x: F.when(x["usd"] > held["usd"], x).otherwise(held))
    rows = rows.withColumn("_best", best)
    total = lambda side: F.transform(side, lambda x: x["usd"])
    action = action_class(F.col("row.token_approve"), F.col("row.cex_id"), F.col("row.project_id"), F.size("_out") > 0, F.size("_in") > 0)
    token = F.nullif(F.col("_best.token_id"), F.lit(""))
    return rows.select(
        event_id(F.col("entity_id"), F.col("wallet"), F.col("chain"), F.col("tx_hash"), F.col("row.idx"), F.col("ts")).alias("event_id"), "entity_id", F.lower("wallet").alias("wallet"), "chain", "tx_hash",
        F.col("row.idx").alias("event_index"), "ts", action.alias("action_type"), "row.cate_id", "row.cex_id", "row.project_id", "cate_name", "cex_name", "project_name", "row.other_addr",
        gross_usd(total("_out"), total("_in")).alias("usd_value"), token.alias("primary_token_id"), asset_key(F.col("chain"), token).alias("primary_asset_key"), F.col("_best.direction").alias("primary_direction"),
        "row.sends", "row.receives", "row.tx", "row.token_approve", "tokens",
    )


def page_cursors(rows: DataFrame, from_ts: int, before: DataFrame | None = None) -> DataFrame:
    """Per (wallet, chain): rows without repeats of (id, idx), the next cursor and whether the history is complete.

    The cursor is the oldest time of the rows that have one, else the cursor before (wallet, chain, cursor; 0 at the start). A history is complete when no row has a time,
    when the cursor does not move back, or when it reaches from_ts.
    """
    single = rows.dropDuplicates(["wallet", "chain", "id", "idx"])
    found = single.groupBy("wallet", "chain").agg(F.count("*").alias("n_rows"), F.coalesce(F.min(F.when(F.col("ts") != 0, F.col("ts"))), F.lit(0)).alias("oldest"))
    if before is None:
        known = found.withColumn("last", F.lit(0).cast("long"))
    else:
        known = found.join(before.select("wallet", "chain", F.col("cursor").alias("last")), ["wallet", "chain"], "left").fillna(0, ["last"])
    oldest, last = F.col("oldest"), F.col("last")
    cursor = F.when(oldest != 0, oldest).otherwise(last)
    complete = (oldest == 0) | ((last != 0) & (oldest >= last)) | (cursor <= from_ts)
    return known.select("wallet", "chain", "n_rows", cursor.alias("cursor"), complete.alias("complete"))


def merge_coverage(ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """The ledger per (entity, wallet, chain) with new pages: covered_from, covered_to, pages, state."""
    both = ledger.unionByName(pages).groupBy("entity_id", "wallet", "chain").agg(F.min("covered_from").alias("covered_from"), F.max("covered_to").alias("covered_to"), F.sum("pages").alias("pages"), F.max((F.col("state") == "complete").cast("int")).alias("_done"))
    return both.withColumn("state", F.when(F.col("_done") == 1, "complete").otherwise("partial")).drop("_done")


def uncovered(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requested spans (entity, wallet, chain, from_ts, to_ts) that no complete ledger row covers."""
    known = ledger.where("state = 'complete'").select("entity_id", "wallet", "chain", "covered_from", "covered_to")
    keys = ["entity_id", "wallet", "chain"]
    held = F.coalesce((F.col("covered_from") <= F.col("from_ts")) & (F.col("covered_to") >= F.col("to_ts")), F.lit(False))
    return requested.join(known, keys, "left").groupBy(*keys, "from_ts", "to_ts").agg(F.bool_or(held).alias("_held")).where("not _held").drop("_held")


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Incoming rows whose key is new, the first of each: the first write of a key wins."""
    first = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(existing.select(key), key, "left_anti")


def asset_symbols(tokens: DataFrame) -> DataFrame:
    """asset_key, symbol, name: the last entry (seq) of each keyed token that has a symbol."""
    keyed = tokens.withColumn("asset_key", asset_key(F.col("chain"), F.col("token_id"))).where("asset_key is not null and coalesce(symbol, '') <> ''")
    return keyed.groupBy("asset_key").agg(F.max_by(F.struct("symbol", "name"), "seq").alias("v")).select("asset_key", "v.symbol", "v.name")


def membership(sources: list[DataFrame]) -> DataFrame:
    """Wallets of all sources: per (entity, address, chain, source) the greatest confidence and the newest metadata. Only 0x addresses are lower-cased."""
    every = reduce(DataFrame.unionByName, sources).withColumn("address", normal_address(F.col("address")))
    return every.groupBy("entity_id", "address", "chain", "source").agg(F.max("confidence").alias("confidence"), F.max_by("meta", "updated_at").alias("meta"))


def discovery_summary(wallets: DataFrame) -> DataFrame:
    return wallets.groupBy("entity_id", "source").agg(F.count_distinct("address").alias("n_addresses"), F.count_distinct("chain").alias("n_chains"))


def append_snapshots(ok: DataFrame, failed: DataFrame) -> DataFrame:
    """Snapshots of both outcomes; failed kinds are kept under the source `error`."""
    return ok.unionByName(failed.withColumn("source", F.lit("error")))


def latest_snapshot(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    return snapshots.groupBy(*keys).agg(F.max_by("payload", "captured_at").alias("payload"), F.max("captured_at").alias("captured_at"))


def missing_enrichment(transactions: DataFrame, enrich: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """(tx_hash, chain, source) that is expected and not stored."""
    wanted = transactions.select("tx_hash", "chain").distinct().withColumn("source", F.explode(F.array(*map(F.lit, expected))))
    return wanted.join(enrich.select("tx_hash", "chain", "source"), ["tx_hash", "chain", "source"], "left_anti")


def dedupe_surface(df: DataFrame, names: tuple[str, ...] = ("signature", "txHash", "id")) -> DataFrame:
    """One row per first non-null of the key columns, else per whole row."""
    whole = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(df.columns)])
    return df.withColumn("surface_key", F.coalesce(*[F.col(c).cast("string") for c in names if c in df.columns], whole)).dropDuplicates(["surface_key"])


def append_market_snapshot(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new).dropDuplicates(["captured_at", "source", "instrument", "kind"])


def enroll(ev: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, event_id of events of a run's entities within its dates; the last day counts in full."""
    joined = ev.join(runs, "entity_id").where((F.col("ts") >= F.col("from_ts")) & (F.col("ts") <= F.col("to_day_ts") + 86399))
    return joined.select("run_id", "event_id")


def entity_dim(rows: DataFrame) -> DataFrame:
    """Configured entities: id required, name defaulting to it; an empty list is an error."""
    out = rows.where(F.coalesce("id", F.lit("")) != "").select("id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"))
    if out.isEmpty():
        raise ValueError("no entity is configured")
    return out


def conform(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """df with every named column (type, default): those it lacks are added, nulls take the default. Additive schema evolution."""
    have = set(df.columns)
    extra = [c for c in df.columns if c not in columns]
    return df.select(*extra, *[(F.coalesce(F.col(c).cast(t), F.lit(v).cast(t)) if c in have else F.lit(v).cast(t)).alias(c) for c, (t, v) in columns.items()])
