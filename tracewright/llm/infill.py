"""Fill-in-middle transformation: a text is cut at two ranks of its units (lines) and put together in another order, with marks that let it be rebuilt.

The ranks are found in an indexable skip list of the text's units. Every link of a lane carries its width twice, in units and in code points, so that a descent by
accumulated unit widths reaches a rank exactly and knows its place in code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A unit is in the lane above with a chance of one in this many.
THIN = 4


class SkipList:
    """Lanes over units of given widths, from the sparsest down to all units. Each lane holds, per link, its units, its code points and the link below that begins where it begins."""

    def __init__(self, widths: np.ndarray, thin: int = THIN):
        n = len(widths)
        mixed = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        starts, points = np.arange(n), widths
        self.n, self.lanes = n, []
        while True:
            self.lanes.append((np.diff(starts, append=n).tolist(), points.tolist(), below.tolist() if self.lanes else None))
            if len(starts) <= thin:
                break
            # The head is in every lane.
            up = mixed[starts] % np.uint64(thin) == 0
            up[0] = True
            mixed = mixed // np.uint64(thin)
            below = np.flatnonzero(up)
            if len(below) == len(starts):
                break
            points, starts = np.add.reduceat(points, below), starts[below]
        self.lanes.reverse()

    def find(self, rank: int) -> int:
        """Code points before the unit of this rank (from 0; n: all)."""
        passed = points_passed = at = 0
        for units, points, below in self.lanes:
            while at < len(units) and passed + units[at] <= rank:
                passed, points_passed, at = passed + units[at], points_passed + points[at], at + 1
            if passed == rank:
                break
            if below is not None:
                at = below[at]
        return points_passed


def line_widths(data: np.ndarray) -> np.ndarray:
    """Code points of every line of a UTF-8 text; the line break belongs to the line."""
    if not len(data):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    starts = starts[starts < len(data)]
    return np.add.reduceat(((data & 0xC0) != 0x80).view(np.uint8), starts, dtype=np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings, without a copy."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix", "middle")]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Units of each text, code points before the first cut and between the cuts; the cuts come after h1 % (n + 1) and h2 % (n + 1) units."""
    offsets, data = utf8(text)
    out = np.zeros((3, len(text)), np.int64)
    for k, (a, b) in enumerate(zip(h1.to_pylist(), h2.to_pylist(), strict=True)):
        lanes = SkipList(line_widths(data[offsets[k] : offsets[k + 1]]))
        low, high = sorted((a % (lanes.n + 1), b % (lanes.n + 1)))
        first = lanes.find(low)
        out[:, k] = lanes.n, first, lanes.find(high) - first
    return pa.StructArray.from_arrays([pa.array(c) for c in out], names=["n", "prefix", "middle"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "7", rate: int = 100, spm: int = 50, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, and `row`, a struct of the columns named in `keep`.

    Cuts and form follow from a hash of salt and id, so a text is cut alike in every run. form is plain (the text itself) if the text is empty or holds a mark, and for 100 - rate of 100
    texts; else spm for `spm` of 100, psm otherwise. Null text counts as empty, a null id as an empty one; prefix_chars and middle_chars are null where form is plain. Repeated rows give equal rows,
    other columns play no part, and an empty table gives no rows. A text is held once more in bytes while its lines are measured, whatever its length; nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc_id = F.col(f"`{id_col}`").cast("long")
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), carried.alias("row"), *[x.alias(f"h{k}") for k, x in enumerate(h, 1)])
    cut = rows.withColumn("c", _cuts("text", "h1", "h2"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("text").contains(mark)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    formed = cut.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    prefix_end, middle_end = F.col("c.prefix"), F.col("c.prefix") + F.col("c.middle")
    piece = lambda start, length: F.substring("text", (start + 1).cast("int"), length.cast("int"))
    prefix, middle, suffix = piece(F.lit(0), prefix_end), piece(prefix_end, F.col("c.middle")), piece(middle_end, F.lit((1 << 31) - 1))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    known = lambda c: F.when(F.col("form") != "plain", c)
    return formed.select("doc_id", F.col("c.n").alias("n"), "form", known(F.col("c.prefix")).alias("prefix_chars"), known(F.col("c.middle")).alias("middle_chars"), output.alias("output"), "row")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    p, s, m = map(F.lit, MARKS)
    one, two = F.lit(1), F.lit(2)
    between = lambda a, b: F.split_part(F.split_part(output, a, two), b, one)
    middle = F.split_part(output, m, two)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """transform()'s rows with hashes in place of texts: that of the output, and that of the text rebuilt from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || doc_id) AS h FROM documents),
  u AS (SELECT *, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
  c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
  f AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM f"""
