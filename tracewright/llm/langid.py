"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix has a fixed size (buckets x languages) and is broadcast; the texts of an Arrow batch are the sparse rows of one matrix and scored together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import frugal

#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 16
#: Lengths of the n-grams.
ORDERS = (1, 2, 3)
#: Labelled documents that the counts are taken from, about: more are thinned by a hash of their text. The bound on the fit's cost.
TRAIN_ROWS = 20_000
#: Added to every count.
SMOOTHING = 0.5
#: Characters whose n-grams are taken at a time; bounds a task's memory whatever a text's length.
BLOCK = 500_000
#: Log-probabilities that are gathered at a time, about.
GATHERED = 1 << 17
UNKNOWN = "und"


def grams(text: str, starts: int | None = None) -> np.ndarray:
    """Buckets of the n-grams of a lower-cased text, or of those that begin in its first `starts` characters; what is no letter counts as one kind of gap.

    Letters are a to z and everything from U+00C0 on but the signs of multiplication and division.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    letter = np.where(chars < 128, (chars >= 97) & (chars <= 122), (chars >= 0xC0) & (chars != 0xD7) & (chars != 0xF7))
    chars = np.where(letter, chars, 32)
    out, mixed = [], np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        mixed = (mixed[: len(chars) - n + 1] * np.uint32(0x01000193)) + chars[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS and len(mixed):
            h = mixed[:starts] ^ (mixed[:starts] >> np.uint32(15))
            out.append((h * np.uint32(0x85EBCA6B) >> np.uint32(16)) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def blocks(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, each once, block by block."""
    lower = text.lower()
    for start in range(0, len(lower), BLOCK):
        yield grams(lower[start : start + BLOCK + max(ORDERS) - 1], BLOCK)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Languages and the log-probabilities of buckets (buckets x languages)."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def totals(self, texts: Iterable[str]) -> np.ndarray:
        """Log-probabilities (texts x languages) up to a constant per text, for texts that are not empty.

        The texts' counts are the sparse rows of a matrix, kept as buckets and weights one row after the other; rows are multiplied with the log-probabilities and summed together.
        """
        rows, buckets, weights, held, done, n = [], [], [], 0, [], 0

        def add() -> None:
            edges = np.cumsum([0, *map(len, buckets[:-1])])
            done.append((list(rows), np.add.reduceat(self.matrix[np.concatenate(buckets)] * np.concatenate(weights)[:, None], edges, axis=0)))
            for part in (rows, buckets, weights):
                part.clear()

        for text in texts:
            for found in blocks(text):
                counts = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS // 4 else None
                used = found if counts is None else np.flatnonzero(counts)
                rows.append(n)
                buckets.append(used)
                weights.append(np.ones(len(used)) if counts is None else counts[used].astype(np.float64))
                held += len(used)
                if held * len(self.languages) >= GATHERED:
                    add()
                    held = 0
            n += 1
        if rows:
            add()
        total = np.tile(np.asarray(self.prior, np.float64), (n, 1))
        for places, sums in done:
            np.add.at(total, places, sums)
        return total

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior probability; `und` and 0 where there is no letter or nothing was learned."""
        out: list[tuple[str, float]] = []
        known: list[int] = []

        def scorable() -> Iterator[str]:
            for text in texts:
                out.append((UNKNOWN, 0.0))
                if text and self.languages and has_letter(text):
                    known.append(len(out) - 1)
                    yield text

        total = self.totals(scorable())
        if known:
            score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for k, b, x in zip(known, total.argmax(axis=1).tolist(), score.tolist(), strict=True):
                out[k] = (self.languages[b], x)
        return out


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4: such documents are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Counts n-grams of labelled documents outside the held-out fold: all, or about `rows` of them, chosen by a hash of the text; counting is done by the executors, where the text is read.

    What reaches the driver is one count per language and used bucket: at most BUCKETS x languages numbers. Rows with null text or language are left
    out. With no labelled row the model knows no language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(id_col)).select("lang", "text")
    share = rows / max(rows, labelled.count())
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                into[BUCKETS] += 1
                for found in blocks(text.as_py()):
                    into[:BUCKETS] += np.bincount(found, minlength=BUCKETS)
        for lang, into in sums.items():
            used = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(into[used], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(frugal(count), "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.zeros((BUCKETS + 1, len(languages)))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    grams_of, docs_of = table[:BUCKETS] + SMOOTHING, table[BUCKETS]
    return Model(languages, np.log(grams_of / grams_of.sum(axis=0)).astype(np.float32), np.log(docs_of / docs_of.sum()) if languages else docs_of)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns by default) plus lang_pred and score (0 to 1). Only the text decides: null or letterless text gives `und` with score 0.

    Whole texts of any length are scored, block by block. Columns named lang_pred or score are replaced; repeated rows get equal values; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    whole = "_text" + "_" * max(map(len, kept), default=0)  # longer than any other name
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(whole))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.predict(t.as_py() for t in batch.column(batch.num_columns - 1))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(frugal(score), schema)
