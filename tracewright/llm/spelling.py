"""Spelling variant grouping: a trie of frequency vectors finds the words that differ by one inserted, deleted or replaced letter.

A word's vector counts its letters by groups. One edit makes one group larger by one (a surplus), one smaller by one (a deficit), or both, so a search through the
trie may spend one of each. Word length and the first levels deal the trie's branches out over the cluster: every word is sent to the branches that its budget can reach, and the
levels below are searched depth first inside a branch, for all words that were sent there at once. Words at the leaves are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import discard, materialize

#: Letters of lower-cased words, and which share of words loses a code point.
LETTERS = "[a-zÀ-ÿ]"
DELETE_ONE_IN = 199
#: Letter groups: code points by their remainder, in the order of the trie's levels.
GROUPS = (5, 1, 9, 4, 2, 3, 14, 15, 12, 8, 0, 13, 7, 6, 10, 11)
#: Levels that deal branches out, beside the length of the word.
TOP = 6
#: Most words of a branch that are searched together; fuller branches are split, and what is sent to them goes to every part.
PART = 5000
#: Words that a task counts before it hands them on, and characters of a text from which on its words are not listed at once.
ENTRIES, LONG = 200_000, 4_000_000

_LEVEL = np.argsort(GROUPS).astype(np.int64)


def count_words(docs: DataFrame, least_chars: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: partial counts of the lower-cased words of whole texts, some of which lose a code point by a hash of id and word. Null texts have no words, a null id counts as empty."""
    run = re.compile(f"{LETTERS}{{{least_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                # Bytes are lower-cased in ASCII only.
                low = text.as_buffer().to_pybytes().lower().decode()
                found = run.findall(low) if len(low) < LONG else (m.group() for m in run.finditer(low))
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % DELETE_ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    held[word] += n
                if len(held) >= ENTRIES:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word string, n long")


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts by group (int32), the columns in the order of the trie's levels."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(row * len(GROUPS) + _LEVEL[codes % len(GROUPS)], minlength=len(words) * len(GROUPS)).reshape(len(words), len(GROUPS)).astype("<i4")


def _branch(found: np.ndarray) -> np.ndarray:
    """Length and first levels of vectors."""
    return np.concatenate([found.sum(axis=1, dtype="<i4")[:, None], found[:, :TOP]], axis=1)


def _steps() -> np.ndarray:
    """Differences of length and first levels from a word to the branches that hold words one edit away, each pair of words met from one side: longer words, and of equally long ones those in one order of branches."""
    unit = np.eye(TOP + 1, dtype="<i4")
    longer, groups = unit[0], unit[1:]
    steps = [0 * longer, longer, *(longer + g for g in groups), *groups]
    return np.array(steps + [groups[i] - groups[j] for i in range(TOP) for j in range(i + 1, TOP)], "<i4")


def _binary(keys: np.ndarray) -> pa.Array:
    width = keys.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, (len(keys) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])


def with_branch(words: DataFrame) -> DataFrame:
    """Adds the branch that each word lies in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(_branch(vectors(batch.column(0).to_pylist())))], names=["word", "n", "branch"])

    return words.select("word", "n").mapInArrow(add, "word string, n long, branch binary")


def _probes(words: DataFrame) -> DataFrame:
    """Each word once for every branch that one edit can reach."""
    steps = _steps()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(-1, 1, TOP + 1)
            keys = (own + steps).reshape(-1, TOP + 1)
            rows = np.flatnonzero((keys >= 0).all(axis=1))
            again = pa.array(rows // len(steps))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), _binary(keys[rows])], names=["word", "n", "branch"])

    return words.select("word", "n", "branch").mapInArrow(send, "word string, n long, branch binary")


def one_edit(a: str, b: str) -> bool:
    """Whether b, of the same length or one longer, differs from a by exactly one replaced or inserted code point."""
    k, n = 0, len(a)
    while k < n and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(b) > n else k < n and a[k + 1 :] == b[k + 1 :]


class Trie:
    """The levels of one branch below those that dealt it out. Inner nodes are dicts by count, leaves lists of words; a word that is alone under a node is a leaf there."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.root = self._grow(np.arange(len(words)), TOP)

    def _grow(self, rows: np.ndarray, level: int):
        if len(rows) == 1 or level == len(GROUPS):
            return rows.tolist()
        values = self.counts[rows, level]
        return {int(v): self._grow(rows[values == v], level + 1) for v in np.unique(values)}

    def search(self, probes: list[str], counts: np.ndarray, branch: np.ndarray) -> list[tuple[int, int]]:
        """(probe, word) pairs one edit apart, by their numbers; depth first, with all probes that still have budget at a node."""
        gap = branch[1:] - counts[:, :TOP]
        longer = branch[0] - counts.sum(axis=1)
        same = ~gap.any(axis=1) & (longer == 0)
        # A word that is longer by one has a surplus only.
        surplus, deficit = (gap > 0).any(axis=1), (gap < 0).any(axis=1) | (longer == 1)
        found: list[tuple[int, int]] = []
        stack = [(self.root, TOP, np.arange(len(probes)), surplus, deficit)]
        while stack:
            node, level, alive, more, less = stack.pop()
            if isinstance(node, list):
                rest = self.counts[node[0], level:] - counts[alive, level:]
                fits = (np.maximum(rest, 0).sum(axis=1) <= ~more) & (np.maximum(-rest, 0).sum(axis=1) <= ~less)
                for p in alive[fits].tolist():
                    for w in node:
                        if (not same[p] or self.words[w] > probes[p]) and one_edit(probes[p], self.words[w]):
                            found.append((p, w))
                continue
            have = counts[alive, level]
            for value, child in node.items():
                d = value - have
                go = np.flatnonzero((d == 0) | ((d == 1) & ~more) | ((d == -1) & ~less))
                if len(go):
                    step = d[go]
                    stack.append((child, level + 1, alive[go], more[go] | (step == 1), less[go] | (step == -1)))
        return found


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """word, near, near_n: every two words (word, n, branch) one edit apart, both ways round.

    Branches hold at most `part` words each: of fuller ones, of which there are fewer than words / part, the words are dealt over parts by a hash and what is sent there goes to all parts. Within a
    task the words of a branch come first and what is sent to it streams past them.
    """
    full = words.groupBy("branch").agg(F.count("*").alias("_have")).where(F.col("_have") > part).select("branch", F.ceil(F.col("_have") / part).cast("int").alias("_parts"))
    full = F.broadcast(full)
    parts = F.coalesce("_parts", F.lit(1))
    held = words.join(full, "branch", "left").select("branch", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.lit(False).alias("probe"), "word", "n")
    sent = _probes(words).join(full, "branch", "left").select("branch", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("probe"), "word", "n")
    both = held.unionByName(sent).repartition("branch", "part").sortWithinPartitions("branch", "part", "probe")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words_, n_, trie = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, ns = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            branches = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, TOP + 1)
            marks = np.concatenate([branches, batch.column(1).to_numpy()[:, None], np.array(batch.column(2).to_pylist(), np.int64)[:, None]], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            counts, out = vectors(names), []
            for i, j in zip(cuts, cuts[1:], strict=False):
                own = tuple(marks[i, :-1].tolist())
                if own != key:
                    key, words_, n_, trie = own, [], [], None
                if not marks[i, -1]:
                    words_ += names[i:j]
                    n_ += ns[i:j]
                elif words_:
                    trie = trie or Trie(words_, vectors(words_))
                    for p, w in trie.search(names[i:j], counts[i:j], branches[i]):
                        out += [(names[i + p], words_[w], n_[w]), (words_[w], names[i + p], ns[i + p])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["word", "near", "near_n"])

    return both.mapInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where a chain of forms (word, form) ends. Each round doubles the links followed; counts grow fivefold with every link, so there are few rounds."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.where("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = materialize(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after
    return now.select("word", "root")


def variants(docs: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of at least least_chars code points that occurs least_n times.

    A word's form is the most frequent word one edit away (of equally frequent ones the first in code-point order), if it is `ratio` times as frequent; root is where following the forms ends. Repeated rows
    count again; other columns play no part; an empty table, or one without such words, gives no rows.
    """
    counted = count_words(docs, least_chars, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    words = materialize(with_branch(counted), "spelling-words")
    near = near_pairs(words, part).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    found = words.select("word", "n").join(near, "word", "left")
    formed = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    told = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")), "spelling-forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
