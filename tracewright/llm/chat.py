"""Chat formatting by token-level assembly: segments are encoded apart, reserved ids are spliced between them, and masks and positions follow from prefix sums.

A turn is  <|im_start|> role <|im_sep|> text <|im_end|>  where the four marks are reserved ids that no text can produce. In the rendered form, control
strings that occur inside roles or texts are escaped: every `<` followed by backslashes (none included) and `|` gets one backslash more, which unescape() takes away.

Conversations are streamed in order through sorted partitions, turn by turn, so that none is held whole in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize
from tracewright.llm.tokens import encoder

#: The marks of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The role whose texts are learned from.
LEARNED = "assistant"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURNS = "conv_id long, seq long, token_start long, n_tokens long, ids binary, mask binary"
#: Rows per batch sent to Spark.
BATCH = 1000


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def reserved(vocabulary: str) -> tuple[int, int, int]:
    """Ids of the three marks: the next after the vocabulary's own."""
    size = encoder(vocabulary, True).tokenizer.get_vocab_size(with_added_tokens=True)
    return size, size + 1, size + 2


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def assemble(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """One row per turn: conv_id, seq (from 0), token_start (within the conversation), n_tokens, ids (unsigned 32-bit) and mask (a byte per token, 1 on the ids of learned texts).

    Turns are ordered by turn, then role and text (nulls first), so ties and repeated rows have a defined place. Null role or text counts as empty; rows
    with a null conv_id form one conversation; other columns are ignored; an empty table gives no rows. A conversation may have any number of turns.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("token_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (start, sep, end) = encoder(vocabulary, True), reserved(vocabulary)
        conv, seq, position, rows = object(), 0, 0, []
        for batch in batches:
            ids_of = [enc.batch(escape(x.as_py() or "") for x in batch.column(k)) for k in (1, 2)]
            for own, role, role_ids, text_ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *ids_of, strict=True):
                if own != conv:
                    conv, seq, position = own, 0, 0
                parts = [np.array([start], "<u4"), np.frombuffer(role_ids, "<u4"), np.array([sep], "<u4"), np.frombuffer(text_ids, "<u4"), np.array([end], "<u4")]
                bounds = np.cumsum([0, *map(len, parts)])
                turn_on = np.zeros(bounds[-1] + 1, np.int8)
                if role == LEARNED:
                    turn_on[bounds[3]] += 1
                    turn_on[bounds[4]] -= 1
                mask = np.cumsum(turn_on[:-1]).astype(np.uint8)
                n = int(bounds[-1])
                rows.append((own, seq, position, n, np.concatenate(parts).tobytes(), mask.tobytes()))
                seq, position = seq + 1, position + n
                if len(rows) >= BATCH:
                    yield _emit(rows, schema)
                    rows = []
        if rows:
            yield _emit(rows, schema)

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(build, TURNS)


def format_conversations(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """assemble(), written to the shared folder and read back."""
    return materialize(assemble(conversations, vocabulary), "chat")


def read_back(assembled: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation, decoded from ids and masks alone: conv_id, n_turns, turns_sha256 (over role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (of all unescaped text under the mask), formatted_chars (of the rendered form), n_tokens, n_loss_tokens."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, (start, sep, end) = encoder(vocabulary, True).tokenizer, reserved(vocabulary)
        decode = lambda ids: tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""
        marks = len(START) + len(SEP) + len(END)
        conv, state, rows = object(), None, []

        def closed() -> tuple:
            return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])

        for batch in batches:
            for own, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != conv:
                    if state:
                        rows.append(closed())
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                middle = int(np.flatnonzero(ids == sep)[0])
                if ids[0] != start or ids[-1] != end:
                    raise ValueError("a turn lacks its marks")
                role, text = decode(ids[1:middle]), decode(ids[middle + 1 : -1])
                if not mask.any():
                    learned = ""
                elif mask[middle + 1 : -1].all():
                    learned = unescape(text)
                else:
                    learned = unescape(decode(ids[mask > 0]))
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(role) + len(text) + marks
                state[5] += len(ids)
                state[6] += int(mask.sum())
                if len(rows) >= BATCH:
                    yield _emit(rows, schema)
                    rows = []
        if state:
            rows.append(closed())
        if rows:
            yield _emit(rows, schema)

    ordered = assembled.select("conv_id", "seq", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(read, out)


def render(assembled: DataFrame, vocabulary: str) -> DataFrame:
    """The readable form, one row per turn: conv_id, seq, text with the template's marks written out and control strings inside texts escaped."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, (_, sep, _) = encoder(vocabulary, True).tokenizer, reserved(vocabulary)
        for batch in batches:
            texts = []
            for ids in batch.column(2).to_pylist():
                ids = np.frombuffer(ids, "<u4")
                middle = int(np.flatnonzero(ids == sep)[0])
                role, text = (tokenizer.decode(x.tolist(), skip_special_tokens=False) if len(x) else "" for x in (ids[1:middle], ids[middle + 1 : -1]))
                texts.append(f"{START}{role}{SEP}{text}{END}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["conv_id", "seq", "text"])

    return assembled.select("conv_id", "seq", "ids").mapInArrow(write, "conv_id long, seq long, text string")
