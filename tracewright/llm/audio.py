"""Audio columns: payloads stored losslessly as 8-bit PCM in RIFF/WAVE, and features computed from the stored bytes.

Features: polyphase resampling, overlapped log-mel frames, and speech-like segments found by energy with hysteresis; frames are cut into
patches of one fixed shape with the time span of each, as an Arrow fixed-shape tensor column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

RATE, TARGET = 16_000, 8_000
#: Taps of the low-pass filter per output phase.
TAPS = 24
FRAME, HOP, MELS = 256, 128, 32
#: Frames in one patch of the tensor column.
PATCH = 64
#: Samples whose spectra are computed at a time; they are the largest of what a payload needs, a fixed multiple of its length being the rest.
BLOCK = 1 << 18
#: Decibels above the median energy at which a segment opens, and below which it closes.
OPEN_DB, CLOSE_DB = 3.0, 1.0


def wave_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit unsigned PCM file holding the payload byte by byte (its length is even here, so no pad byte follows)."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wave_payload(media: bytes) -> tuple[bytes, int]:
    """The samples' bytes and the rate, found by walking the chunks."""
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


@lru_cache
def low_pass(up: int, down: int) -> np.ndarray:
    """Windowed-sinc filter in polyphase form: one row of TAPS coefficients per output phase."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / up, 1 / down)
    h = up * cut * np.sinc(cut * t) * np.hamming(n)
    return h.reshape(TAPS, up).T[:, ::-1].astype(np.float32).copy()


def resample(samples: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up/down: only the outputs that stay are computed, each from TAPS inputs."""
    bank, n = low_pass(up, down), -(-len(samples) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1, np.float32), samples]), TAPS)
    out = np.empty(n, np.float32)
    for first in range(up):
        at = np.arange(first, n, up) * down
        if len(at):
            step = slice(int(at[0]) // up, None, down)
            out[first::up] = (windows[step][: len(at)] @ bank[int(at[0]) % up])[: len(at)]
    return out


@lru_cache
def mel_bank() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale (frequency bins x filters)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(TARGET / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / TARGET)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@lru_cache
def hann() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values of overlapping frames, and each frame's energy in decibels; a signal under one frame is padded with zeros."""
    if len(signal) < FRAME:
        signal = np.concatenate([signal, np.zeros(FRAME - len(signal), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    mels, energy = [], []
    for start in range(0, len(frames), BLOCK // FRAME):
        part = frames[start : start + BLOCK // FRAME] * hann()
        spectrum = np.fft.rfft(part, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(power @ mel_bank() + np.float32(1e-6)))
        energy.append(10 * np.log10(power.sum(axis=1) / FRAME + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Frame spans [first, last + 1) that open where energy rises open_db above its median and close where it falls under close_db above it."""
    level = energy - np.median(energy)
    state = np.where(level >= open_db, 1, np.where(level < close_db, -1, 0))
    known = np.flatnonzero(state)
    if not len(known):
        return []
    last = np.searchsorted(known, np.arange(len(state)), side="right") - 1
    active = np.where(last >= 0, state[known[np.maximum(last, 0)]] > 0, False).astype(np.int8)
    edge = np.diff(np.concatenate([[0], active, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(payload: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Patches (n x PATCH x MELS in half precision, the last filled with zeros), each patch's span in seconds (n x 2), and the energy segments in frames."""
    from math import gcd

    common = gcd(rate, TARGET)
    signal = (np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    mel, energy = log_mel(resample(signal, TARGET // common, rate // common))
    n = -(-len(mel) // PATCH)
    patches = np.zeros((n * PATCH, MELS), np.float16)
    patches[: len(mel)] = mel
    starts = np.arange(n) * PATCH * HOP / TARGET
    ends = np.minimum(starts + (PATCH * HOP + FRAME - HOP) / TARGET, len(payload) / rate)
    return patches.reshape(n, PATCH, MELS), np.stack([starts, ends], axis=1), segments(energy)


def tensor_batch(patches: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """Patches as an Arrow fixed-shape tensor column, beside start_s and end_s."""
    kind = pa.fixed_shape_tensor(pa.float16(), [PATCH, MELS], dim_names=["frame", "mel"])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(patches.reshape(-1), pa.float16()), PATCH * MELS)
    return pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, storage), pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["log_mel", "start_s", "end_s"])


def tensor_bytes(patches: np.ndarray, spans: np.ndarray) -> bytes:
    """The batch as an Arrow stream, which a Spark binary column can hold."""
    batch, sink = tensor_batch(patches, spans), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text), media (the WAVE file). Null text counts as empty and gives 64 zero bytes; a null id stays null;
    repeated rows stay; other columns are ignored; an empty table gives no rows. The payload is the whole text, whatever its length."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array([wave_bytes(padded(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table, written to the shared folder and read back."""
    return materialize(encode(docs, id_col, text_col), "media")


def extract(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Features of stored media: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, n_segments,
    segments (spans in seconds), feature (a printable digest of the above), and tensor (Arrow stream bytes of the patches; null unless `tensors`).

    Equal media give equal values, since each is computed on its own. A null media value, which stored() never gives, has nulls in all columns but doc_id and n_bytes.
    """
    out = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "n_frames long, n_segments long, segments array<struct<start_s double, end_s double>>, feature string, tensor binary"
    )
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), span, pa.string(), pa.binary()]
    names = [x.split()[0] for x in out.split(", ") if not x.startswith("end_s")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n_bytes, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not cell.is_valid:
                    rows.append((doc, n_bytes, *[None] * (len(kinds) - 2)))
                    continue
                media = cell.as_buffer().to_pybytes()
                payload, rate = wave_payload(media)
                patches, spans, found = features(payload, rate)
                n_frames = 1 + max(0, -(-len(payload) * TARGET // rate) - FRAME) // HOP
                mel = patches.reshape(-1, MELS)[:n_frames]
                times = [{"start_s": a * HOP / TARGET, "end_s": min(((b - 1) * HOP + FRAME) / TARGET, len(payload) / rate)} for a, b in found]
                feature = f"frames={n_frames};patches={len(patches)};segments={len(found)};mean={','.join(f'{x + 0.0:.2f}' for x in mel[:, :: MELS // 8].mean(axis=0, dtype=np.float64))}"
                rows.append((doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), n_frames, len(found), times, feature, tensor_bytes(patches, spans) if tensors else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, out)


def stored_features(media: DataFrame) -> DataFrame:
    """extract() with the tensor and the segments' spans of every document, written to the shared folder and read back."""
    return materialize(extract(media), "tensors")


def tensor_feature(data: bytes, n_frames: int, times: list[dict]) -> str:
    """The digest of one document, from its stored tensor and segments alone: numbers, the means of all filters, and hashes of the patches, their spans and the segments' spans."""
    read = read_tensors(data)
    patches = read.column("log_mel").combine_chunks().storage.flatten().to_numpy(zero_copy_only=False) if read.num_rows else np.zeros(0, np.float16)
    spans = [read.column(c).to_numpy() for c in ("start_s", "end_s")]
    mean = patches.reshape(-1, MELS)[:n_frames].mean(axis=0, dtype=np.float64)
    segment = np.array([(t["start_s"], t["end_s"]) for t in times], np.float64)
    crcs = [zlib.crc32(np.ascontiguousarray(x).tobytes()) for x in (patches, np.stack(spans, axis=1), segment)]
    return f"frames={n_frames};patches={read.num_rows};segments={len(times)};mean={','.join(f'{x + 0.0:.2f}' for x in mean)};tensor={crcs[0]:08x};spans={crcs[1]:08x};times={crcs[2]:08x}"


def from_tensors(stored: DataFrame) -> DataFrame:
    """The columns of extract() but segments and tensor, with `feature` derived from the tensor that was read back."""
    kept = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "n_segments"]
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_segments long, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column("tensor"), batch.column("n_frames").to_pylist(), batch.column("segments").to_pylist(), strict=True)
            found = [tensor_feature(cell.as_buffer().to_pybytes(), n, times) if cell.is_valid else None for cell, n, times in cells]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string())], names=[*kept, "feature"])

    return stored.select(*kept, "segments", "tensor").mapInArrow(digest, out).select(*kept[:7], "feature", *kept[7:])


def read_tensors(data: bytes) -> pa.Table:
    """The patches of one media row, as stored in `tensor`."""
    return pa.ipc.open_stream(data).read_all()
