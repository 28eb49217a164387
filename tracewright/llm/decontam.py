"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct 5-word shingles (powers of two). An item that is contained with similarity t in a document may miss at most
the fraction 1 - t of its shingles there, so of any floor((1 - t) n) + 1 of them the document has at least one. The item's MinHash sketch is
that many least hashes, sized by its partition's upper bound: a document that has none of them cannot contain the item, whatever the document's length.

Items are sketched in tasks, whatever their number. A bitmap of their sketch hashes, of bounded size, goes to every task and lets few of the documents' shingles through; these meet
the sketches in a join, and the pairs of text and item that come of it are verified on the shingles themselves, over the whole text. Equal texts are searched once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import discard, frugal, materialize

SHINGLE, THRESHOLD = 5, 0.8
#: Bits of the bitmap for each sketch hash, and its least and greatest size (powers of two; 128 MB at most). A full bitmap lets more shingles into the join, and loses none.
BITS_A_HASH, LEAST_BITS, MOST_BITS = 64, 20, 30
#: Counted rows, and counted characters of items, up to which a side of a join is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 1_000_000, 8_000_000
#: Distinct words whose hashes a Python worker keeps before it starts afresh.
WORDS = 1_000_000
#: Rows of a batch that a task hands on.
GATHERED = 65_536
WORD = re.compile(r"[^\W_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall(text.lower())


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > WORDS:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


def shingle_hashes(words: list[str], size: int, known: WordHashes) -> np.ndarray:
    """A hash for each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total = each[:n].copy()
    for k in range(1, size):
        total *= MULTIPLIER
        total += each[k : k + n]
    return total ^ (total >> np.uint64(29))


def shingles(words: list[str], size: int) -> set[str]:
    return {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


def needed(n: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * n - 1e-9)


def sketches(items: DataFrame) -> DataFrame:
    """item_key, size (words of a shingle), hash: the sketch of every item (item_key, text) that has a word."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for batch in batches:
            rows = []
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(cell.as_py())
                size = min(SHINGLE, len(words))
                hashes = np.unique(shingle_hashes(words, size, known)) if words else []
                if len(hashes):
                    upper = 1 << (len(hashes) - 1).bit_length()
                    rows += [(key, size, h) for h in hashes[: upper - needed(upper) + 1].view(np.int64).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["item_key", "size", "hash"])

    return items.mapInArrow(frugal(sketch), "item_key long, size int, hash long")


def bitmap(hashes: DataFrame, rows: int) -> np.ndarray:
    """A power of two of bits as bytes, one set for the low end of every hash: gathered as 64 bits a row, 2 ** (MOST_BITS - 6) rows at most."""
    size = min(max((BITS_A_HASH * rows - 1).bit_length(), LEAST_BITS), MOST_BITS)
    at = F.col("hash").bitwiseAND((1 << size) - 1)
    words = hashes.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63L as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (size - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _text_keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _survivors(texts: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """h1, h2, size, hash: the distinct shingles of each row's text whose bit is set."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    names = ["h1", "h2", "size", "hash"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, _known()
        low, parts, held = np.uint64(8 * len(own) - 1), [], 0

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

        for batch in batches:
            for h1, h2, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(cell.as_py())
                for size in sizes:
                    found = shingle_hashes(words, size, known)
                    at = found & low
                    found = np.unique(found[(own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                    if len(found):
                        parts.append((np.full(len(found), h1), np.full(len(found), h2), np.full(len(found), size, np.int32), found.view(np.int64)))
                        held += len(found)
                if held > GATHERED:
                    yield gathered()
                    parts, held = [], 0
        if parts:
            yield gathered()

    return texts.mapInArrow(frugal(search), "h1 long, h2 long, size int, hash long")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """h1, h2, item_key, n_shared, n_item of the pairs (h1, h2, item_key, text of the item) whose text (h1, h2, text; one row each) contains the item.

    A text and its items arrive in one stream, the text first, so that neither is repeated and a task holds one text at a time.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("item_key", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by_size = [], {}
        for batch in batches:
            rows = []
            for h1, h2, key, cell in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
                own = words_of(cell.as_py())
                if key < 0:
                    words, by_size = own, {}
                    continue
                size = min(SHINGLE, len(own))
                if size not in by_size:
                    by_size[size] = shingles(words, size)
                parts = shingles(own, size)
                n = len(parts & by_size[size])
                if n >= needed(len(parts)):
                    rows.append((h1, h2, key, n, len(parts)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    stream = texts.select("h1", "h2", F.lit(-1).cast("long").alias("item_key"), "text").unionByName(pairs.select("h1", "h2", "item_key", "text"))
    return stream.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "item_key").mapInArrow(frugal(compare), "h1 long, h2 long, item_key long, n_shared long, n_item long")


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _search(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """h1, h2, item_key, item_id, n_shared, n_item: the items (rows) that each distinct text contains, written to the shared folder."""
    named = items.select(F.monotonically_increasing_id().alias("item_key"), F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    named = materialize(named.where(F.col("text").isNotNull()), "decontam-items")
    chars = named.agg(F.sum(F.length("text") + 20)).first()[0] or 0
    sketched = materialize(sketches(named.select("item_key", "text")), "decontam-sketches")
    rows = sketched.count()
    sizes = [r["size"] for r in sketched.select("size").distinct().collect()]
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(*_text_keys(text), text.alias("text")).where(F.col("text").isNotNull())
    survivors = _survivors(keyed, bitmap(sketched, rows), sorted(sizes))
    pairs = survivors.join(_hinted(sketched, rows <= BROADCAST_ROWS), ["size", "hash"]).select("h1", "h2", "item_key").distinct()
    pairs = materialize(pairs, "decontam-pairs")
    wanted = materialize(pairs.select("h1", "h2").distinct(), "decontam-wanted")
    texts = keyed.join(_hinted(wanted, wanted.count() <= BROADCAST_ROWS), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("text").alias("text"))
    with_items = pairs.join(_hinted(named.select("item_key", "text"), chars <= BROADCAST_CHARS), "item_key")
    found = _verified(texts, with_items).join(_hinted(named.select("item_key", "item_id"), chars <= BROADCAST_CHARS), "item_key")
    out = materialize(found, "decontam-found")
    discard(named, sketched, pairs, wanted)
    return out


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every document that contains at least THRESHOLD of an item's distinct shingles.

    Items under five words count as one shingle of all their words; items or documents without a word (null and empty texts) match nothing. Repeated documents or
    items give a row each; null ids are carried; other columns are ignored; an empty table on either side gives no rows. The search runs, and is written, when this is called.
    """
    found = _search(docs, items, text_col, item_id, item_text)
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *_text_keys(F.col(f"`{text_col}`").cast("string")))
    joined = ids.join(_hinted(found, found.count() <= BROADCAST_ROWS), ["h1", "h2"])
    return joined.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


_words: list[WordHashes] = []


def _known() -> WordHashes:
    if not _words:
        _words.append(WordHashes())
    return _words[0]


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, whose text contains no item. Rows with null text stay."""
    hit = _search(docs, items, text_col, item_id, item_text).select("h1", "h2").distinct()
    text = F.col(f"d.`{text_col}`").cast("string")
    h1, h2 = _text_keys(text)
    same = text.isNotNull() & (h1 == F.col("hit.h1")) & (h2 == F.col("hit.h2"))
    return docs.alias("d").join(_hinted(hit, hit.count() <= BROADCAST_ROWS).alias("hit"), same, "left_anti")


#: The same search in SQL, shingle by shingle.
ORACLE = """
WITH iw AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, i, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS g
       FROM (SELECT *, least(5, len(w)) AS m FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, i, m, count(*) AS n_item FROM ig GROUP BY ALL),
dw AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, d, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS g
       FROM dw, (SELECT DISTINCT m FROM n) WHERE len(w) >= m)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM dg JOIN ig USING (m, g) JOIN n USING (item_id, i, m) GROUP BY doc_id, d, item_id, i, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)
"""
