"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within r bits share a variant within r/2 of both. Emitting every 64-bit variant within 2 of every fingerprint makes 2081 rows each, so the
ball is first drawn in half of the bits: a pair within 4 bits differs in at most 2 bits of one half, so the two share a variant within 1 bit of that half
(33 per half). Colliding pairs are verified on all bits. Where many distinct fingerprints collide on one such variant, their pairs would be too many; these fingerprints
emit their whole ball over all 64 bits instead. Those that meet on a full variant lie within 2 + 2 bits of each other, so one link to the least of them suffices.

Texts that have 0.8 of their shingles in common differ in about ten bits of 64, out of reach of any such ball. deduplicate() therefore also compares texts that share a
band of MinHash minima, by all their shingles.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import discard, frugal, materialize
from tracewright.operators.graph import connected_components

SHINGLE, SEED = 4, 42
#: Bits that linked fingerprints may differ in; the ball's radius is half of it.
RADIUS = 4
#: Distinct fingerprints on one half-variant up to which its pairs are compared; more of them meet on full variants.
SMALL = 48
#: Rows of (key, number) up to which the keys that many fingerprints share are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: deduplicate(): words of a shingle and least share of common shingles for documents to be near-duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Bands of minima per document, and minima of a band. At the least similarity a band is equal in 0.41 of all cases, and one of the 16 in 0.9998.
BANDS, PER_BAND = 16, 4
#: Pairs with one partner that a task compares; the partner's shingles are repeated for more.
FAN = 500
#: Shingles that one Arrow batch holds, about.
BATCH_SHINGLES = 1 << 18
_draw = random.Random(3).getrandbits
FLIPS, FACTORS, MIXERS = (np.array([_draw(64) | 1 for _ in range(BANDS * PER_BAND)], np.uint64) for _ in range(3))


def hashes_of(text: str, span: int) -> np.ndarray:
    """XXH64 of the shingles of `span` words in their order, repeats included (ASCII lower case, words between ASCII white space); fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(span, len(words))
    slices = [joined[a:b] for a, b in zip(starts.tolist(), ends[span - 1 :].tolist(), strict=False)]
    return np.fromiter(map(xxh64_intdigest, slices, repeat(SEED)), "<u8", len(slices))


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of a text's 4-word shingles."""
    hashes = hashes_of(text, SHINGLE)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def shingle_set(text: str) -> np.ndarray:
    """Hashes of the distinct shingles of WORDS words, ascending."""
    return np.unique(hashes_of(text, WORDS))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of minima, the band's number mixed in; texts without shingles share all keys."""
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[at : at + 4096] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * MIXERS
    return mixed.reshape(BANDS, PER_BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * MIXERS[0]


def with_sketches(df: DataFrame, text_col: str, bands: bool = False) -> DataFrame:
    """All columns of df, in which `text_col` is a string, and each row's fingerprint fp; with `bands` its number of distinct shingles n and the bands' keys as well."""
    place = df.columns.index(text_col)
    fields = [T.StructField("fp", T.LongType()), *([T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))] if bands else [])]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, keys = [], [], []
            for value in batch.column(place):
                text = value.as_py() or ""
                prints.append(fingerprint(text))
                if bands:
                    own = shingle_set(text)
                    sizes.append(len(own))
                    keys.append(band_keys(own).view("<i8"))
            columns = [pa.array(prints, pa.int64()), *([pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))] if bands else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(frugal(compute), T.StructType([*df.schema.fields, *fields]))


def half_variants(fps: DataFrame) -> DataFrame:
    """key, fp: each half of the bits and its variants within 1 bit, the half's number in the key's top bits."""
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
    low, high = F.col("fp").bitwiseAND((1 << 32) - 1), F.shiftrightunsigned("fp", 32)
    halves = F.array(low, high.bitwiseOR(1 << 32))
    return fps.select("fp", F.explode(halves).alias("half")).select("fp", "half", F.explode(flips).alias("flip")).select(F.col("half").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def full_variants(fps: DataFrame) -> DataFrame:
    """key, fp: all variants within 2 bits."""
    pairs = fps.select("fp", F.explode(F.expr("sequence(0, 64)")).alias("i")).select("fp", "i", F.explode(F.expr("sequence(i, 64)")).alias("j")).where("j < 64 or i = 64")
    mask = F.expr("case when i = 64 then 0L when i = j then shiftleft(1L, i) else shiftleft(1L, i) | shiftleft(1L, j) end")
    return pairs.select(F.col("fp").bitwiseXOR(mask).alias("key"), "fp")


def bucket_links(fps: str) -> str:
    """SQL for the links that join up one bucket (a sorted array column): every member near the first one is linked to it, every other one to a single near member of
    those, and the others among themselves. These have the components of all pairs."""
    close = lambda a, b: f"bit_count({a} ^ {b}) <= {RADIUS}"
    near, rest = (f"filter({fps}, x -> {how} {close('x', f'{fps}[0]')})" for how in ("", "not"))
    star = f"transform(slice({near}, 2, size({fps})), x -> struct({fps}[0] as src, x as dst))"
    one = f"flatten(transform({rest}, r -> slice(transform(filter({near}, x -> {close('x', 'r')}), x -> struct(x as src, r as dst)), 1, 1)))"
    among = f"flatten(transform({rest}, (r, i) -> transform(filter(slice({rest}, i + 2, size({fps})), x -> {close('x', 'r')}), x -> struct(r as src, x as dst))))"
    return f"concat({star}, {one}, {among})"


def links(fps: DataFrame) -> DataFrame:
    """src, dst: links between distinct fingerprints (column fp, each once) whose components are those of all pairs within RADIUS bits."""
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS
    emitted = half_variants(fps)
    met = materialize(emitted.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1"), "simhash-met")
    two = met.where("n = 2").select("src", "dst").where(close)
    more = met.where("n > 2").select("key", "n")
    members = materialize(emitted.join(F.broadcast(more) if more.count() <= BROADCAST_ROWS else more, "key"), "simhash-members")
    few = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    some = few.select(F.explode(F.expr(bucket_links("fps"))).alias("e")).select("e.src", "e.dst")
    dense = members.where(F.col("n") > SMALL).select("fp").distinct()
    stars = full_variants(dense).withColumn("src", F.min("fp").over(Window.partitionBy("key"))).where("src != fp").select("src", F.col("fp").alias("dst"))
    out = materialize(two.unionByName(some).unionByName(stars).distinct(), "simhash-links")
    discard(met, members)
    return out


def groups(marked: DataFrame, further: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """fp, component for every distinct fingerprint: the least fingerprint reachable over links within RADIUS bits and those (src, dst) that `further` makes of these."""
    nodes = materialize(marked.select("fp").distinct(), "simhash-nodes")
    found = links(nodes)
    more = None if further is None else further(found)
    joined = connected_components(found if more is None else found.unionByName(more)).withColumnRenamed("node", "fp")
    discard(found, *([] if more is None else [more]))
    return nodes.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def shingle_sets(marked: DataFrame, text_col: str, rows: DataFrame) -> DataFrame:
    """row, shingles (hashes of the distinct ones) of the given rows."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(row)
                sets.append(shingle_set(text.as_py() or "").view("<i8"))
                held += len(sets[-1])
                if held >= BATCH_SHINGLES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["row", "shingles"])
                    ids, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["row", "shingles"])

    small = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return materialize(marked.select("row", text_col).join(small, "row", "left_semi").mapInArrow(frugal(compute), "row long, shingles array<long>"), "simhash-shingles")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst: the fingerprints fa, fb of the pairs (rows a, b) that have SIMILARITY of their shingles in common. A row b of many pairs is dealt out by a."""
    pairs = materialize(pairs, "simhash-pairs")
    often = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts")).where("parts > 1"), "simhash-often")
    small = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(small, "b", "left").select("a", "fa", "b", "fb", F.pmod(F.hash("a"), parts).alias("part"))
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb")).join(small, "b", "left").select("b", "sb", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = dealt.join(left, "a").join(right, ["b", "part"])
    near = both.where(common >= SIMILARITY * (F.size("sa") + F.size("sb") - common) - 1e-9)
    out = materialize(near.select(F.col("fa").alias("src"), F.col("fb").alias("dst")).distinct(), "simhash-similar")
    discard(often, pairs)
    return out


def _fits(a: str, b: str):
    """Whether two numbers of shingles allow the similarity."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-9


def _across(members: DataFrame, edges: DataFrame) -> DataFrame:
    """a, fa, b, fb, cb: rows that share a bucket and are in different components, a from outside the bucket's largest one; cb is b's component."""
    reached = connected_components(edges).withColumnRenamed("node", "fp")
    placed = materialize(members.join(reached, "fp", "left").select("key", "row", "fp", "n", F.coalesce("component", "fp").alias("c")), "simhash-placed")
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    apart = materialize(placed.join(mixed, "key"), "simhash-apart")
    outside = apart.where("c != main").select("key", "main", F.col("row").alias("a"), F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("c").alias("ca"))
    inside = apart.select("key", F.col("row").alias("b"), F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    one_side = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))
    out = materialize(outside.join(inside, "key").where((F.col("ca") != F.col("cb")) & one_side & _fits("na", "nb")).select("a", "fa", "b", "fb", "cb").distinct(), "simhash-across")
    discard(placed, apart)
    return out


def similar_texts(marked: DataFrame, text_col: str, found: DataFrame) -> DataFrame:
    """src, dst: links between fingerprints of texts that share a band of minima and have SIMILARITY of their shingles in common.

    marked has text_col, row (unique), fp, n and keys; `found` are the links that there are already. Together their components are those of all such pairs: each text is compared with
    the least of the bucket that it shares with most bands, then with one text of each other component in its buckets, then with all texts there that are still in another component.
    """
    hashed = marked.select("row", "fp", "n", "keys", F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"))
    texts = hashed.groupBy("text_hash", "fp").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    placed = materialize(texts.select("row", "fp", "n", F.explode("keys").alias("key")), "simhash-bands")
    least = placed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("row", "fp", "n")).alias("pivot")).where("size > 1").select("key", "pivot")
    crowded = materialize(least, "simhash-crowded")
    members = materialize(placed.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded, "key"), "simhash-members")
    discard(placed, crowded)
    used = materialize(members.select("row").distinct(), "simhash-used")
    sets = shingle_sets(marked, text_col, used)
    other = members.select(F.col("row").alias("a"), F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("pivot.row").alias("b"), F.col("pivot.fp").alias("fb"), F.col("pivot.n").alias("nb"))
    apart = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) > RADIUS
    counted = other.where((F.col("a") != F.col("b")) & apart & _fits("na", "nb")).groupBy("a", "fa", "b", "fb").agg(F.count("*").alias("bands"))
    chosen = counted.groupBy("a", "fa").agg(F.max(F.struct("bands", (-F.col("b")).alias("first"), "b", "fb")).alias("p")).select("a", "fa", "p.b", "p.fb")
    edges = similar_pairs(chosen, sets)
    for single in (True, False):
        open_pairs = _across(members, found.unionByName(edges))
        pairs = open_pairs.groupBy("a", "fa", "cb").agg(F.min(F.struct("b", "fb")).alias("p")).select("a", "fa", "p.b", "p.fb").distinct() if single else open_pairs.drop("cb")
        before, more = edges, similar_pairs(pairs, sets)
        edges = materialize(before.unionByName(more), "simhash-similar")
        discard(open_pairs, before, more)
    discard(members, used, sets)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over links of RADIUS bits or fewer, the document itself included.

    One row per input row. Equal fingerprints are one node, so copies cost nothing further; empty and null texts share the fingerprint zero. Null ids
    never become a component_id unless a whole component has no other; other columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = materialize(with_sketches(narrow, "text").select("doc_id", "fp"), "fingerprints")
    labelled = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups(marked), "fp")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs per group of near-duplicates, columns unchanged: the one of least id (nulls last); of rows that share the id, any one.

    Near-duplicates are linked within RADIUS bits of their shingles' fingerprints, or if SIMILARITY of their distinct shingles of WORDS words are common and a band of their
    minima is equal, as it is in 0.9998 of such cases and more. Null and empty texts are near-duplicates of each other; other columns may have any names; an empty table gives no rows.
    """
    plain = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, plain, strict=True))
    numbered = docs.select(*[F.col(f"`{c}`").alias(of[c]) for c in docs.columns]).withColumn(of[text_col], F.col(of[text_col]).cast("string")).withColumn("row", F.monotonically_increasing_id())
    marked = materialize(with_sketches(numbered, of[text_col], bands=True), "simhash-documents")
    grouped = groups(marked, partial(similar_texts, marked, of[text_col]))
    order = F.struct(F.col(of[id_col]).isNull(), F.col(of[id_col]), F.col("row"))
    narrow = marked.select(of[id_col], "row", "fp").join(grouped, "fp")
    kept = materialize(narrow.groupBy("component").agg(F.min_by("row", order).alias("row")).select("row"), "simhash-kept")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    return marked.join(kept, "row", "left_semi").select(*[F.col(of[c]).alias(c) for c in docs.columns])
