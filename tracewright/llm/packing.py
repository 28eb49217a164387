"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, pieces of one length form a bucket, and no sequence crosses documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import frugal, scratch
from tracewright.llm.tokens import encoder

PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long"
STORED = "sequence_id long, doc_id long, start long, doc_tokens long, ids binary, length int"
#: Pieces per Arrow batch sent back to Spark.
BATCH = 4096


def binary_lengths(n: int, longest: int) -> list[int]:
    """The pieces of n tokens, longest first: as many of `longest` as fit, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: str, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, each a sequence of its own: doc_id, start, length (a power of two up to `longest`), ids (unsigned 32-bit, little-endian), doc_tokens.

    Null text counts as empty: the document is then the end id alone. A null id stays null; repeated rows are packed once each; other columns are
    ignored; an empty table gives no rows. A text of any length is cut into `longest` pieces and one piece per binary digit of the rest.
    There is no padding: pieces are made where the text is read.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rows = encoder(vocabulary, True), []
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), enc.batch(texts), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n))
                    start += length
                while len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[:BATCH], strict=True), schema, strict=True)], schema=schema)
                    rows = rows[BATCH:]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(frugal(cut), PIECES)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the pieces with one folder per length, the buckets that a training job draws equal-length batches from. A piece's sequence_id is the number of its row."""
    numbered = packed.withColumn("sequence_id", F.monotonically_increasing_id())
    numbered.select("sequence_id", "doc_id", "start", "doc_tokens", "ids", "length").write.option("compression", "zstd").partitionBy("length").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The sequences of all buckets: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset (0: a sequence is one piece). Lengths and sums are those of the stored ids."""
    stored = spark.read.schema(STORED).parquet(path)
    length = F.expr("cast(octet_length(ids) div 4 as long)")
    return stored.select("doc_id", "start", length.alias("length"), "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() written to buckets of equal length in the shared folder and read back from there."""
    path = scratch(docs.sparkSession, "packed")
    write_buckets(pieces(docs, vocabulary, longest, end_id, id_col, text_col), path)
    return read_buckets(docs.sparkSession, path)
