"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Each task first combines its own copies (the map side of the first grouping), the salted groups of a digest are merged, and the winners of the salts are combined
over all. The whole normalised text is part of every grouping key, so a digest only deals rows out and never decides that texts are equal. Texts whose hash no other row has are
told from the rest first, by a bitmap of fixed size, and are not sent anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

#: Fixed value: the characters that are deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Groups that one digest's copies are merged in before they are combined.
SALTS = 32
#: A group with more than one in so many of all rows is broadcast when rows look their group up: there are fewer such groups than this.
HOT_SHARE = 1000
#: Bits of the bitmap that marks the hashes of more than one row; it is broadcast, and fills 16 MB at most.
BITS = 1 << 27
_BIAS, _SPAN = 1 << 63, 1 << 64


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _lit(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _rank(chars: Column, doc_id: Column) -> Column:
    """One number for (most characters, least id), the null id last: a fixed-width buffer keeps the grouping a hash aggregation."""
    place = F.coalesce(doc_id.cast("decimal(20,0)") + _lit(_BIAS), _lit(_SPAN)).cast("decimal(20,0)")
    return (chars.cast("decimal(10,0)") * _lit(2 * _SPAN) + (_lit(_SPAN) - place)).cast("decimal(38,0)")


def _unrank(rank: Column) -> tuple[Column, Column]:
    """Characters and id of a rank."""
    rest = (rank % _lit(2 * _SPAN)).cast("decimal(20,0)")
    doc_id = F.when(rest != 0, (_lit(_BIAS) - rest).cast("long"))
    return ((rank - rest) / _lit(2 * _SPAN)).cast("long"), doc_id


def _slot(content: Column) -> Column:
    """A bit's number, from 1."""
    return F.pmod(F.xxhash64(content), F.lit(BITS)) + 1


def mark_shared(rows: DataFrame) -> DataFrame:
    """Adds `shared` to rows with a content: false only where no other row has an equal one. A full bitmap marks every row, which costs time and changes no result. The bitmap is written once."""
    counted = rows.select(F.xxhash64("content").alias("hash"), _slot(F.col("content")).alias("slot")).groupBy("hash", "slot").agg(F.count("*").alias("n")).where("n > 1")
    bits = materialize(counted.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits")), "exact-bitmap")
    placed = rows.withColumn("_slot", _slot(F.col("content"))).withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(bits), "_bucket", "left")
    bit = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.expr("shiftright(_byte, cast(_bit % 8 as int))").bitwiseAND(1) == 1
    return placed.withColumn("_byte", byte).withColumn("_bit", bit).withColumn("shared", F.coalesce(on, F.lit(False))).select(*rows.columns, "shared")


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, content, keep_chars, keep_id, group_size of rows (digest, content, chars, doc_id)."""
    ranked = rows.select((F.spark_partition_id() % salts).alias("salt"), "digest", "content", _rank(F.col("chars"), F.col("doc_id")).alias("best"))
    local = ranked.groupBy("salt", "digest", "content").agg(F.max("best").alias("best"), F.count("*").alias("size"))
    whole = local.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("size").alias("group_size"))
    chars, doc_id = _unrank(F.col("best"))
    return whole.select("digest", "content", chars.alias("keep_chars"), doc_id.alias("keep_id"), "group_size")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256, and `row`, a struct of the columns named in `keep`.

    Texts are equal when nothing but BLANKS tells them apart; of equal ones the row with the most code points stays, then that of the least id, a null id last. Null text counts
    as empty. Rows that repeat both id and text all count in group_size, and one of them stays. Other columns play no part, whatever their names; an empty table gives no rows.

    `digest` may be any function of the content: where it is the same for different contents, rows meet their group by the content as well. A group that holds more than one in HOT_SHARE of
    the rows with copies is looked up by broadcast, and its rows are dealt out by their ids afterwards.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), F.regexp_replace(text, BLANKS, "").alias("content"), carried.alias("row"))
    rows = mark_shared(rows).select("doc_id", "chars", "content", "row", "shared", digest(F.col("content")).alias("digest"), sha256(F.col("content")).alias("text_sha256"))
    found = combine(rows.where("shared"), salts)
    groups = materialize(found.drop("content"), "exact-groups")
    best = F.struct("keep_chars", "keep_id", "group_size")
    alone = F.struct(F.col("chars").alias("keep_chars"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    own_key = F.concat(F.lit("-"), F.xxhash64("content").cast("string"))
    if groups.groupBy("digest").count().where("count > 1").isEmpty():
        copied = groups.agg(F.sum("group_size")).first()[0] or 0
        hot = groups.where(F.col("group_size") * HOT_SHARE > copied).select("digest", best.alias("_hot"))
        placed = rows.withColumn("_own", own_key).drop("content").join(F.broadcast(hot), "digest", "left")
        stays = F.col("doc_id").eqNullSafe(F.col("_hot.keep_id")) & (F.col("chars") == F.col("_hot.keep_chars"))
        apart = F.concat(F.lit("+"), F.xxhash64("doc_id", "chars").cast("string"))
        key = F.when(~F.col("shared"), F.col("_own")).when(F.col("_hot").isNull() | stays, F.col("digest")).otherwise(apart)
        joined = placed.withColumn("_key", key).join(groups.select(F.col("digest").alias("_key"), best.alias("_best")), "_key", "left")
        joined = joined.withColumn("_best", F.coalesce("_hot", "_best"))
    else:
        named = materialize(found, "exact-groups").select(F.col("digest").alias("_digest"), F.col("content").alias("_content"), best.alias("_best"))
        same = F.col("shared") & (F.col("digest") == F.col("_digest")) & (F.col("content") == F.col("_content"))
        joined = rows.join(named, same, "left").withColumn("_key", F.when(F.col("shared"), F.col("content")).otherwise(own_key))
    joined = joined.withColumn("_best", F.when(F.col("shared"), F.col("_best")).otherwise(alone))
    stays = F.col("doc_id").eqNullSafe(F.col("_best.keep_id")) & (F.col("chars") == F.col("_best.keep_chars"))
    first = F.row_number().over(Window.partitionBy("_key", "_stays").orderBy("doc_id")) == 1
    told = joined.withColumn("_stays", stays).withColumn("kept", F.col("_stays") & first)
    return told.select("doc_id", F.col("_best.keep_id").alias("keep_id"), F.col("_best.group_size").alias("group_size"), "kept", "text_sha256", "row")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return verdicts(docs, id_col, text_col, keep=docs.columns).where("kept").select("row.*")


ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS v FROM documents)
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY v) AS group_size, row_number() OVER w = 1 AS kept, sha256(v) AS text_sha256
  FROM t WINDOW w AS (PARTITION BY v ORDER BY length(x) DESC, doc_id)"""
