"""Secret scans with ownership frequency, in DataFrame functions only.

Matches of each kind come from regexp_extract_all, their positions from the lengths of what split() leaves between them. Every candidate value is hashed where its text
is read, so that no value is written or shuffled, and its hash is counted over the distinct repositories and owners that hold it: a value with one owner looks live, one that many
owners hold is a copied example. Tokens of digits and letters of both cases outside the base kinds are added as spans when their value belongs to a single owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import discard, materialize

#: The kinds in their listed order, and the expression of each.
KINDS = ("assign", "access", "hex", "generic")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
#: Least characters of an assigned value and of an access key.
ASSIGN_MIN, ACCESS_MIN = 6, 20
#: Owners from which on a value counts as copied.
COPIED_OWNERS = 3


def _kept(kind: int, hit: Column, value: Column) -> Column:
    """Whether a match of a kind passes the kind's limits."""
    if KINDS[kind] == "generic":
        return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
    return F.length(value) >= {"assign": ASSIGN_MIN, "access": ACCESS_MIN}.get(KINDS[kind], 0)


def _hits(text: Column, pattern: str, kind: int) -> Column:
    """All matches of one kind, in order: kind, its number k, characters since the match before (gap) and of the match (size), whether it passes (fits), the value's hash."""

    def one(pair: Column, k: Column) -> Column:
        hit = pair["hit"]
        value = F.regexp_extract(hit, ASSIGN, 2) if KINDS[kind] == "assign" else hit
        gap, size = F.length(pair["gap"]).alias("gap"), F.length(hit).alias("size")
        return F.struct(F.lit(kind).alias("kind"), k.alias("k"), gap, size, _kept(kind, hit, value).alias("fits"), F.sha2(value, 256).alias("hash"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    every = F.filter(F.transform(F.arrays_zip(found.alias("hit"), between.alias("gap")), one), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), every).otherwise(F.lit(None))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source") -> DataFrame:
    """row (an id for each input row), doc_id, repository, owner, found (array of matches). Neither the text nor a value goes any further."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repository = F.coalesce(F.col(repository_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), repository.alias("repository"), text.alias("_text"))
    found = [F.coalesce(_hits(F.col("_text"), p, k), F.expr("cast(array() as array<struct<kind int, k int, gap int, size int, fits boolean, hash string>>)")) for k, p in enumerate((ASSIGN, ACCESS, HEX, GENERIC))]
    return narrow.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "repository", F.split_part("repository", F.lit("/"), F.lit(1)).alias("owner"), F.concat(*found).alias("found")
    )


def spans(found: DataFrame) -> DataFrame:
    """row, repository, owner, kind, start, end (code points, end exclusive), hash: matches that pass their kind's limits; generic ones that touch no base span."""
    each = found.select("row", "repository", "owner", F.explode("found").alias("h")).select("row", "repository", "owner", "h.*")
    order = Window.partitionBy("row", "kind").orderBy("k")
    before = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", before).withColumn("start", F.col("end") - F.col("size")).where("fits")
    base = F.col("kind") < 3
    earlier = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_left", F.max(F.when(base, F.col("end"))).over(earlier)).withColumn("_right", F.min(F.when(base, F.col("start"))).over(later))
    apart = (F.coalesce("_left", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_right"), F.col("end")) >= F.col("end"))
    return each.where(base | apart).select("row", "repository", "owner", "kind", "start", "end", "hash")


def ownership(found_spans: DataFrame) -> DataFrame:
    """hash, n_places, n_repositories, n_owners, status (live, shared or copied) of every candidate value.

    Counted in three grouped steps, each of which combines before it shuffles, so that a value held by a third of all rows is a few partial rows.
    """
    by_repository = found_spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    counted = by_owner.groupBy("hash").agg(F.sum("n").alias("n_places"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))
    status = F.when(F.col("n_owners") >= COPIED_OWNERS, "copied").when(F.col("n_owners") == 1, "live").otherwise("shared")
    return counted.withColumn("status", status)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source") -> DataFrame:
    """doc_id, secrets (array of kind, start, end, hash, status by start and kind) for every input row.

    Null text counts as empty and gives an empty array; a null repository is one unknown owner; the owner is what stands before the first `/` of the repository;
    null and repeated ids give a row per input row; other columns are ignored; an empty table gives no rows. Spans are joined to their value's
    counts on the hash; adaptive execution splits the join where one value is very frequent.
    """
    found = materialize(candidates(docs, id_col, text_col, repository_col), "secrets")
    marked = materialize(spans(found), "secret-spans")
    status = ownership(marked).select("hash", "status")
    known = marked.join(status, "hash").where((F.col("kind") < 3) | (F.col("status") == "live"))
    by_row = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "hash", "status"))).alias("s"))
    by_row = by_row.select("row", F.transform("s", lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hash"].alias("hash"), x["status"].alias("status"))).alias("secrets"))
    none = F.expr("cast(array() as array<struct<kind string, start bigint, end bigint, hash string, status string>>)")
    out = found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("secrets", none).alias("secrets"))
    report = materialize(out, "secret-report")
    discard(found, marked)
    return report


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and printed spans of each scanned row."""
    count = lambda name, value: F.size(F.filter("secrets", lambda x: x[name] == value)).cast("long")
    shown = lambda only: F.array_join(F.transform(F.filter("secrets", only), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id", *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(shown(lambda x: x["kind"] != "generic"), 256).alias("base_sha256"), shown(lambda x: F.lit(True)).alias("spans"),
        count("kind", "generic").alias("n_generic"), *[count("status", s).alias(f"n_{s}") for s in ("live", "shared", "copied")],
    )


#: The same scan in SQL.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS repository FROM documents),
m AS (SELECT r, repository, kind, k, CASE kind WHEN 0 THEN regexp_extract_all(t, $re${ASSIGN}$re$)[k] WHEN 1 THEN regexp_extract_all(t, $re${ACCESS}$re$)[k]
             WHEN 2 THEN regexp_extract_all(t, $re${HEX}$re$)[k] ELSE regexp_extract_all(t, $re${GENERIC}$re$)[k] END AS hit, gaps
      FROM (SELECT r, repository, kind, t, gaps, unnest(range(1, len(gaps))) AS k FROM (
            SELECT r, repository, t, kind, CASE kind WHEN 0 THEN string_split_regex(t, $re${ASSIGN}$re$) WHEN 1 THEN string_split_regex(t, $re${ACCESS}$re$)
                   WHEN 2 THEN string_split_regex(t, $re${HEX}$re$) ELSE string_split_regex(t, $re${GENERIC}$re$) END AS gaps FROM d, (VALUES (0), (1), (2), (3)) p(kind)))),
s AS (SELECT r, repository, split_part(repository, '/', 1) AS owner, kind, hit, sum(len(gaps[k]) + len(hit)) OVER (PARTITION BY r, kind ORDER BY k)::BIGINT AS e FROM m),
v AS (SELECT r, repository, owner, kind, hit, e - len(hit) AS b, e, CASE kind WHEN 0 THEN regexp_extract(hit, $re${ASSIGN}$re$, 2) ELSE hit END AS value FROM s),
f AS (SELECT * FROM v WHERE CASE kind WHEN 0 THEN len(value) >= {ASSIGN_MIN} WHEN 1 THEN len(value) >= {ACCESS_MIN}
      WHEN 3 THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') ELSE true END),
a AS (SELECT f.* FROM f WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f x WHERE x.r = f.r AND x.kind < 3 AND x.b < f.e AND x.e > f.b)),
o AS (SELECT value, count(DISTINCT owner) AS n_owners FROM a GROUP BY value),
z AS (SELECT a.*, CASE WHEN n_owners >= {COPIED_OWNERS} THEN 'copied' WHEN n_owners = 1 THEN 'live' ELSE 'shared' END AS status FROM a JOIN o USING (value)),
y AS (SELECT *, ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || b || ':' || e AS shown FROM z WHERE kind < 3 OR status = 'live'),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_generic,
             coalesce(string_agg(shown, ',' ORDER BY b, kind) FILTER (kind < 3), '') AS base, string_agg(shown, ',' ORDER BY b, kind) AS spans,
             count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'shared') AS n_shared, count(*) FILTER (status = 'copied') AS n_copied FROM y GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_generic, 0) AS n_generic, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (r)
"""
