"""Token ids in Arrow's random-access file format: equal-length sequences and masks in fixed-size-list columns, so that a reader maps a file and slices it without copying.

Documents are range-partitioned by id; every partition writes one file (a shard) through pyarrow's file systems into a shared folder and reports
where each of its documents begins. A task that runs again writes a new file, and only the file that its rows name counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, running_total, scratch
from tracewright.llm.tokens import encoder

INDEX = "doc_id long, row long, path string, local long, n_tokens long"
#: Sequences per record batch of a file.
ROWS = 256


def sequence_schema(length: int, width: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends ids to one file of sequences of `length`; the last one is padded with zeros that the mask leaves out."""

    def __init__(self, folder: str, length: int, width: pa.DataType):
        filesystem, base = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.arrow"
        self.path, self.length, self.width, self.schema = f"{folder}/{name}", length, width, sequence_schema(length, width)
        self.sink = filesystem.open_output_stream(f"{base}/{name}")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.held_ids, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> int:
        """The position of the document's first id in this file."""
        at = self.total
        self.held.append(ids.astype(self.width.to_pandas_dtype()))
        self.held_ids += len(ids)
        self.total += len(ids)
        if self.held_ids >= ROWS * self.length:
            self._flush(self.held_ids // (ROWS * self.length) * ROWS)
        return at

    def _flush(self, rows: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.width.to_pandas_dtype())
        keep = ids[rows * self.length :]
        self._write(ids[: rows * self.length], rows * self.length)
        self.held, self.held_ids = [keep], len(keep)

    def _write(self, ids: np.ndarray, real: int) -> None:
        for start in range(0, len(ids), ROWS * self.length):
            part = ids[start : start + ROWS * self.length]
            mask = np.arange(start, start + len(part)) < real
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(part, self.width), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(self.held_ids // self.length)
        if self.held_ids:
            rest = np.concatenate([self.held[0], np.zeros(self.length - self.held_ids, self.held[0].dtype)])
            self._write(rest, self.held_ids)
        self.writer.close()
        self.sink.close()


class ShardReader:
    """Random access to a shard by sequence or by position; record batches all hold ROWS sequences but the last two, so a position tells its batch."""

    def __init__(self, path: str):
        filesystem, name = fs.FileSystem.from_uri(path)
        source = pa.memory_map(name) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}

    def batch(self, k: int) -> pa.RecordBatch:
        if k not in self.batches:
            self.batches = {k: self.file.get_batch(k)}
        return self.batches[k]

    def ids(self, start: int, count: int) -> np.ndarray:
        """`count` ids from position `start` on; only the record batches that hold them are touched."""
        out, end, full = [], start + count, ROWS * self.length
        k = min(start // full, self.file.num_record_batches - 1)
        low = k * full
        while start < end:
            flat = self.batch(k).column("input_ids").flatten().to_numpy(zero_copy_only=True)
            if start >= low + len(flat):
                low, k = low + len(flat), k + 1
                continue
            out.append(flat[start - low : end - low])
            start = min(end, low + len(flat))
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, length: int = 1024, end_id: int = 2, keeps_space: bool = False, wide: bool = False) -> DataFrame:
    """Writes the ids of all documents in ascending id order, each closed by `end_id`, and returns the index: doc_id, row (place within its shard), path, local (position there), n_tokens.

    Ids are stored in 16 bits unless `wide`. Null text counts as empty; null ids sort first; repeated ids keep one entry per row; other columns are
    ignored; an empty table gives an empty index. Sequences of a shard are filled from its own documents, so a shard ends in at most one padded one.
    The index is materialized, so nothing is written a second time when it is read again.
    """
    folder = folder or scratch(docs.sparkSession, "token-files")
    width = pa.uint32() if wide else pa.uint16()
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("path", pa.string()), ("local", pa.int64()), ("n_tokens", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, row, index = encoder(vocabulary, keeps_space), None, 0, []
        if not wide and max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16:
            raise ValueError("the vocabulary's ids need wide=True")
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.batch(t.as_py() or "" for t in batch.column(1)), strict=True):
                shard = shard or ShardWriter(folder, length, width)
                found = np.frombuffer(ids + end, "<u4")
                index.append((doc, row, shard.path, shard.add(found), len(found)))
                row += 1
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), schema, strict=True)], schema=schema)

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(write, INDEX), "token-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """Reads every document's ids back from the files: doc_id, row, path, n_tokens, start (ids of all documents before it), ids_crc32 (of unsigned 32-bit little-endian ids)."""
    out = "doc_id long, row long, path string, n_tokens long, start long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            rows = batch.to_pydict()
            crc = []
            for p, local, n in zip(rows["path"], rows["local"], rows["n_tokens"], strict=True):
                if p != path:
                    path, shard = p, ShardReader(p)
                crc.append(zlib.crc32(shard.ids(local, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(crc, pa.int64())], names=["doc_id", "row", "path", "n_tokens", "start", "ids_crc32"])

    numbered = running_total(index, ["doc_id", "path", "row"], "n_tokens", "start")
    grouped = numbered.select("doc_id", "row", "path", "n_tokens", "start", "local").repartition("path").sortWithinPartitions("path", "row")
    return grouped.mapInArrow(read, out)
