"""Repeated passages by suffix arrays: maximal repeat groups of at least LENGTH bytes, with all their occurrences, over the whole corpus.

Every LENGTH-byte window is keyed by the least hash of the GRAM-byte strings in it, so that equal windows have equal keys wherever they start. Runs of windows
under one key form a piece of text; pieces are gathered by key, and an enhanced suffix array is built for the keys that hold different
pieces. A stack scan over its common prefixes walks the interval tree and keeps the intervals of LENGTH bytes or more that are left-diverse: their occurrences are preceded by
different bytes or stand at the beginning of a piece. Keys with a single text that occurs twice need no sorting: the text is one group.

A repeat that is longer than a piece appears as overlapping groups, one per piece; covered() joins them. Keys that very many places share would
make one task's array too large; their distinct pieces are cut into single windows, which are grouped by content through a shuffle that combines first.
Texts are compared as bytes within a task, and between tasks by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

#: Bytes of the shortest repeat, and of the strings whose least hash is a window's key.
LENGTH, GRAM = 200, 32
#: Bytes handled at a time for long texts.
BLOCK = 1 << 20
#: Distinct pieces of a key above which they are grouped window by window.
HOT = 3000
#: Bytes of pieces that are sorted together.
SORTED = 200_000
#: Bits (as a power of two) of the filter that keeps pieces of other keys out of shuffles: 4 MB, whatever the corpus. It only saves work; when full, nothing is lost.
FILTER = 25
#: Spans up to which they are broadcast to the texts; beyond, the join shuffles.
BROADCAST_SPANS = 500_000
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _window_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each LENGTH-byte window, and the places from which on another string (in value or place) gives the key."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(data * _powers(ODD, BLOCK + LENGTH)[:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _powers(INVERSE, BLOCK + LENGTH)[: n - GRAM + 1]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    width = LENGTH - GRAM + 1
    padded = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = grams
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(grams) - width + 1
    keys = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
    return keys, np.flatnonzero((keys[1:] != keys[:-1]) | (grams[: m - 1] == keys[:-1])) + 1


def pieces(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(key, start, windows) of the runs of windows whose key comes from one place (the first of equal ones), so that no piece holds a window twice; keys are signed."""
    for low in range(0, len(data) - LENGTH + 1, BLOCK):
        keys, edges = _window_keys(np.frombuffer(data, np.uint8, count=min(BLOCK + LENGTH - 1, len(data) - low), offset=low).astype(np.uint64))
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        for key, a, b in zip(keys[starts].view(np.int64).tolist(), starts.tolist(), ends.tolist(), strict=True):
            yield key, low + a, b - a


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


KINDS = {"key": ("long", pa.int64()), "content": ("binary", pa.binary()), "body": ("binary", pa.binary()), "doc_id": ("long", pa.int64()), "text_hash": ("long", pa.int64()), "start": ("long", pa.int64()), "windows": ("long", pa.int64())}


def _emit(texts: DataFrame, names: list[str], wanted: np.ndarray | None = None) -> DataFrame:
    """Pieces of all texts with the named columns; `wanted` is a filter of keys."""
    schema = pa.schema([(n, KINDS[n][1]) for n in names])
    shared = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        bits = None if shared is None else shared.value
        rows = []
        for batch in batches:
            for doc, text_hash, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = cell.as_buffer().to_pybytes()
                for key, start, windows in pieces(data):
                    if bits is not None:
                        at = key & ((1 << FILTER) - 1)
                        if not bits[at >> 3] >> (at & 7) & 1:
                            continue
                    body = data[start : start + windows + LENGTH - 1]
                    own = {"key": key, "content": xxh3_128_digest(body), "body": body, "doc_id": doc, "text_hash": text_hash, "start": start, "windows": windows}
                    rows.append(tuple(own[n] for n in names))
                if len(rows) > 4096:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)

    return texts.mapInArrow(emit, ", ".join(f"{n} {KINDS[n][0]}" for n in names))


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the keys' low ends, as bytes of a fixed number: gathered as at most 2 ** (FILTER - 6) words."""
    at = F.col("key").bitwiseAND((1 << FILTER) - 1)
    words = keys.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63L as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def common_prefixes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to `most`; the buffer ends in 8 spare bytes."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    words = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    while len(live):
        at = out[live]
        same = words[np.minimum(a[live] + at, len(words) - 1)] == words[np.minimum(b[live] + at, len(words) - 1)]
        whole = same.all(axis=1)
        out[live] = at + np.where(whole, 8, np.argmin(same, axis=1))
        live = live[whole & (out[live] < most[live])]
    return np.minimum(out, most)


def repeat_tree(bodies: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Maximal repeats among pieces: (piece, offset, length, group) for every occurrence, each given the deepest left-diverse interval that holds it.

    The suffix array holds the suffixes whose window occurs twice; intervals of the common-prefix tree come from one scan with a stack, which also carries
    the byte to the left of an interval's suffixes for as long as it is one and the same. Groups are numbered from 0; one group nested in another shares its occurrences upwards.
    """
    where, offset, seen = [], [], {}
    for k, body in enumerate(bodies):
        for at in range(len(body) - LENGTH + 1):
            seen.setdefault(body[at : at + LENGTH], []).append((k, at))
    places = [p for found in seen.values() if len(found) > 1 for p in found]
    if not places:
        return []
    del seen
    places.sort(key=lambda p: (bodies[p[0]][p[1] :], p))
    base = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    buffer = np.frombuffer(b"".join(bodies) + bytes(16), np.uint8)
    where, offset = np.array([p[0] for p in places]), np.array([p[1] for p in places])
    position, rest = base[where] + offset, base[where + 1] - base[where] - offset
    prefix = common_prefixes(buffer, position[:-1], position[1:], np.minimum(rest[:-1], rest[1:])).tolist()
    left = np.where(offset > 0, buffer[position - 1].astype(np.int64), -1).tolist()
    owner, lengths = np.full(len(places), -1, np.int64), []

    # A stack entry: common prefix, first suffix, left byte (None: more than one), suffixes so far without a group.
    def close(depth: int, byte: int | None, loose: list[int]) -> list[int]:
        if depth < LENGTH or byte is not None:
            return loose
        owner[loose] = len(lengths)
        lengths.append(depth)
        return []

    stack: list[list] = []
    for i in range(len(places)):
        depth = prefix[i] if i < len(prefix) else 0
        byte, loose = (left[i] if left[i] >= 0 else None), [i]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            top[1] = byte if top[1] == byte else None
            top[2].extend(loose)
            byte, loose = top[1], close(*top)
        if depth >= LENGTH:
            if stack and stack[-1][0] == depth:
                stack[-1][1] = byte if stack[-1][1] == byte else None
                stack[-1][2].extend(loose)
            else:
                stack.append([depth, byte, loose])
    return [(int(where[i]), int(offset[i]), lengths[owner[i]], int(owner[i])) for i in np.flatnonzero(owner >= 0)]


GROUPS = "key long, content binary, offset long, length long, repeat long"


def _trees(distinct: DataFrame) -> DataFrame:
    """Groups among the distinct pieces of each key: key, content (of the piece), offset, length, repeat (the group's id, from its bytes)."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.binary()), ("offset", pa.int64()), ("length", pa.int64()), ("repeat", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        held: list[tuple[int, bytes, bytes]] = []

        def sort() -> list[tuple]:
            bodies, out, named = [b for _, _, b in held], [], {}
            for k, offset, length, group in repeat_tree(bodies):
                if group not in named:
                    named[group] = xxh3_64_intdigest(bodies[k][offset : offset + length]) - (1 << 63)
                out.append((*held[k][:2], offset, length, named[group]))
            return out

        size, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != last and size > SORTED:
                    if found := sort():
                        yield _batch(found, schema)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[2])
        if found := sort():
            yield _batch(found, schema)

    return distinct.select("key", "content", "body").repartition("key").sortWithinPartitions("key", "content").mapInArrow(build, GROUPS)


def _windows(distinct: DataFrame) -> DataFrame:
    """The same for keys of very many places: single windows that occur twice, grouped by content. Cutting makes many rows of one piece, so the pieces are spread first."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.binary()), ("offset", pa.int64()), ("window", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for key, content, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _batch([(key, content, k, xxh3_128_digest(body[k : k + LENGTH])) for k in range(len(body) - LENGTH + 1)], schema)

    each = distinct.select("key", "content", "body").repartition("content").mapInArrow(cut, "key long, content binary, offset long, window binary")
    twice = each.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return each.join(twice, "window").select("key", "content", "offset", F.lit(LENGTH).cast("long").alias("length"), F.xxhash64("window").alias("repeat"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, data: rows that agree in id and text share the first two."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast("binary").alias("data")).select("doc_id", F.xxhash64("doc_id", "data").alias("text_hash"), "data")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeat groups with all occurrences: repeat (group), length, doc_id, text_hash, start (byte offset). One row per occurrence.

    Texts are UTF-8 bytes; null text counts as empty; nothing matches across documents; null ids are carried; rows that agree in id and text are separate
    documents whose occurrences share one row each; other columns are ignored; an empty table gives no rows. A text of any length is read block by block.
    """
    texts = _texts(docs, id_col, text_col)
    counted = _emit(texts, ["key", "content"]).groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("least"), F.max("content").alias("most"))
    shared = materialize(counted.where("n > 1").select("key", "n", F.when(F.col("least") == F.col("most"), F.col("least")).alias("only")), "repeat-keys")
    mixed = shared.where("only is null")
    found = _emit(texts, ["key", "content", "body"], key_filter(mixed)).groupBy("key", "content").agg(F.count("*").alias("n"), F.min("body").alias("body"))
    distinct = materialize(found, "repeat-pieces")
    hot = distinct.groupBy("key").agg(F.count("*").alias("pieces")).where(F.col("pieces") > HOT).select("key")
    few = F.broadcast(hot) if hot.count() <= BROADCAST_SPANS else hot
    alone = shared.where("only is not null").select("key", F.col("only").alias("content"))
    copied = distinct.where("n > 1").select("key", "content").unionByName(alone).select("key", "content", F.lit(0).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.xxhash64("content").alias("repeat"))
    groups = _trees(distinct.join(few, "key", "left_anti")).unionByName(_windows(distinct.join(few, "key", "left_semi"))).unionByName(copied.distinct())
    groups = materialize(groups, "repeat-groups")
    places = _emit(texts, ["key", "content", "doc_id", "text_hash", "start", "windows"], key_filter(shared))
    length = F.coalesce("length", F.col("windows") + LENGTH - 1)
    return places.join(groups, ["key", "content"]).select("repeat", length.alias("length"), "doc_id", "text_hash", (F.col("start") + F.col("offset")).alias("start"))


def covered(occurrences: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans: the occurrences of each document as (start, length), with those of one start reduced to the longest."""
    longest = occurrences.groupBy("doc_id", "text_hash", "start").agg(F.max("length").alias("length"))
    return longest.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes), removed (array of start, end) for every row of docs: every byte that a repeat of LENGTH bytes covers goes."""
    spans = materialize(covered(repeats(docs, id_col, text_col)), "repeat-spans")
    total = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    spans = F.broadcast(spans) if total <= BROADCAST_SPANS else spans
    texts = _texts(docs, id_col, text_col)
    both = texts.join(spans.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "spans"), (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    flat = both.select("doc_id", "data", F.transform("spans", lambda x: x["start"]).alias("starts"), F.transform("spans", lambda x: x["length"]).alias("lengths"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.list_(pa.int64())))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, cell, starts, lengths in zip(batch.column(0).to_pylist(), batch.column(1), *[batch.column(k).to_pylist() for k in (2, 3)], strict=True):
                data, runs = cell.as_buffer().to_pybytes(), []
                for start, length in zip(starts or [], lengths or [], strict=True):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], start + length)
                    else:
                        runs.append([start, start + length])
                edges = [0, *[x for run in runs for x in run], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc, len(data), len(data) - len(kept), len(runs), kept, runs))
            if rows:
                yield _batch(rows, schema)

    return flat.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<array<long>>")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
