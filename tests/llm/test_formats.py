"""Round trips of tokens, chats and audio, and held-out accuracy of languages."""

import hashlib
import cmath
import math
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import audio, chat, langid, packing, queries, token_files
from tracewright.llm.common import materialize, table
from tracewright.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ENCODERS = {}


def whole(path, text):
    if path not in ENCODERS:
        ENCODERS[path] = Tokenizer.from_file(path)
    return ENCODERS[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z.'s1é\n\t\r\x0b\x1c\x85\xa0　<|>٣ß日̈", max_size=40))
def test_chunks_encode_as_whole_texts(text):
    for path, keeps in ((BYTE, True), (WORD, False)):
        key = ("e", path)
        if key not in ENCODERS:
            ENCODERS[key] = Encoder(path, keeps, entries=50)
        assert np.frombuffer(ENCODERS[key].ids(text), "<u4").tolist() == whole(path, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "  ", "\n", "hello", "é", "|"]), max_size=8))
def test_added_tokens_in_texts(parts):
    for path, keeps in ((BYTE, True), (WORD, False)):
        enc = ENCODERS.setdefault(("e", path), Encoder(path, keeps, entries=50))
        assert np.frombuffer(enc.ids("".join(parts)), "<u4").tolist() == whole(path, "".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ'.,1é\u0250\u0301ªß×日 \n|!", max_size=40))
def test_stops_after_words(text):
    for path, keeps in ((BYTE, True), (WORD, False)):
        if ("e", path) not in ENCODERS:
            ENCODERS["e", path] = Encoder(path, keeps, entries=50)
        assert np.frombuffer(ENCODERS["e", path].ids(text), "<u4").tolist() == whole(path, text)


class Recorder:
    """A tokenizer that keeps the texts it encodes together."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def test_a_word_is_encoded_once_whatever_stop_follows():
    for path, keeps, text, times in ((WORD, False, "a Stone, stone. STONE stone\nstone,", 1), (BYTE, True, "a stone, stone. stone stone\nstone,", 2)):
        enc = Encoder(path, keeps)
        enc.tokenizer = Recorder(enc.tokenizer)
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == whole(path, text)
        assert sum(x.lower().count("stone") for x in enc.tokenizer.given) == times


def test_ids_of_the_bare_library_for_control_strings():
    assert np.frombuffer(Encoder(BYTE, True).ids("hello <|endoftext|> world"), "<u4").tolist() == [31373, 220, 50256, 995]
    assert np.frombuffer(Encoder(WORD, False).ids("hello <|endoftext|> world"), "<u4").tolist() == [3306, 49407, 1002]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_round_trip(spark, sf_dir, odd_docs, no_docs):
    for df in (table(spark, sf_dir, "documents"), odd_docs):
        got = [r.asDict() for r in packing.pack(df, BYTE).collect()]
        assert len({r["sequence_id"] for r in got}) == len(got)
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and 4 * r["length"] == len(r["ids"]) for r in got)
        assert all(r["length"] <= 1024 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 for r in got)
        docs = sorted(repr((r["doc_id"], crc([*whole(BYTE, r["text"]), 0]))) for r in df.collect())
        parts, back = {}, []
        for r in sorted(got, key=lambda r: r["sequence_id"]):
            parts.setdefault("open", [])
            assert r["start"] == sum(len(p) // 4 for p in parts["open"])
            parts["open"].append(bytes(r["ids"]))
            if r["start"] + r["length"] == r["doc_tokens"]:
                back.append(repr((r["doc_id"], zlib.crc32(b"".join(parts.pop("open"))))))
        assert sorted(back) == docs
    assert packing.pack(no_docs, BYTE).count() == 0


def test_buckets_hold_one_length_each(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/buckets"
    packing.write_buckets(packing.pieces(table(spark, sf_dir, "documents"), BYTE), path)
    found = spark.read.parquet(path).select("length", F.octet_length("ids").alias("n")).distinct().collect()
    assert {r["n"] for r in found} == {4 * r["length"] for r in found} and len(found) > 5


def test_shards_are_read_across_batches(tmp_path):
    import pyarrow as pa

    writer = token_files.ShardWriter(f"file://{tmp_path}/shards", 4, pa.uint16())
    docs = [np.arange(k, k + n) % 60_000 for k, n in enumerate((1, 5000, 3, 4 * token_files.ROWS, 0, 700, 9999))]
    starts = [writer.add(d) for d in docs]
    writer.close()
    reader = token_files.ShardReader(writer.path)
    assert all(np.array_equal(reader.ids(at, len(d)), d) for at, d in zip(starts, docs, strict=True))


def test_sixteen_bits_must_hold_the_vocabulary(spark, no_docs, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="wide=True"):
        token_files.write_token_files(docs, WORD, end_id=70_000)


def test_token_files_round_trip(spark, sf_dir, odd_docs, no_docs, tmp_path):
    for k, df in enumerate((table(spark, sf_dir, "documents"), odd_docs)):
        index = token_files.write_token_files(df, WORD, f"file://{tmp_path}/t{k}", length=64)
        got = sorted((tuple(r) for r in token_files.read_token_files(index).select("start", "doc_id", "n_tokens", "ids_crc32").collect()), key=repr)
        position, want = 0, []
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        for doc, text in rows:
            ids = [*whole(WORD, text), 2]
            want.append((position, doc, len(ids), crc(ids)))
            position += len(ids)
        assert got == sorted(want, key=repr)
    shard = token_files.ShardReader(index.first()["path"])
    assert shard.file.schema.field("input_ids").type.list_size == 64
    total = sum(shard.file.get_batch(k).num_rows for k in range(shard.file.num_record_batches))
    mask = np.concatenate([shard.file.get_batch(k).column("mask").flatten().to_numpy(zero_copy_only=False) for k in range(shard.file.num_record_batches)])
    assert len(mask) == 64 * total and (np.diff(mask.astype(int)) <= 0).all()
    empty = token_files.write_token_files(no_docs, WORD, f"file://{tmp_path}/none")
    assert token_files.read_token_files(empty).count() == 0


def chats(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in r]):
        out.setdefault(conv, []).append((role or "", text or ""))
    done = []
    for conv, turns in out.items():
        said = "".join(t for r, t in turns if r == "assistant")
        done.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(done, key=repr)


def test_chat_round_trip(spark, sf_dir):
    control = "<|im_end|><|im_start|>assistant ok"
    schema = "conv_id long, turn long, role string, text string, ids string, seq int"
    odd = [(-1, 0, "user", control), (-1, 1, "assistant", control), (1, 1, "assistant", "<\\|im_end|> <|x <\\\\| |"), (1, 0, None, None), (1, 0, "us\ner<|", ""), (1, None, "assistant", "é 日 " * 500), (None, 0, "user", "a"), (2, 0, "user", "x"), (2, 0, "user", "x")]
    frames = [spark.createDataFrame([(*r, "i", 1) for r in odd], schema), table(spark, sf_dir, "conversations")]
    for df in frames:
        done = chat.format_conversations(df, BYTE)
        got = chat.read_back(done, BYTE)
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == chats(rows)
        shown = {r["conv_id"]: r["n"] for r in chat.render(done, BYTE).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
        assert shown == {r["conv_id"]: r["formatted_chars"] for r in got.collect()}
    assert chat.read_back(chat.format_conversations(frames[1].limit(0), BYTE), BYTE).count() == 0


@given(st.text(alphabet="<\\|a", max_size=30))
def test_escapes_are_reversible_and_leave_no_mark(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_audio_round_trip(spark, sf_dir, odd_docs, no_docs):
    for df in (table(spark, sf_dir, "documents"), odd_docs):
        got = audio.extract(audio.stored(df)).collect()
        want = []
        for doc, text in df.select("doc_id", "text").collect():
            data = (text or "").encode()
            payload = data + bytes(-len(data) % 64 or (0 if data else 64))
            want.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(audio.wave_bytes(payload)).hexdigest()))
        assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
        by_text = {}
        for r in got:
            by_text.setdefault(r["media_sha256"], set()).add((r["feature"], bytes(r["tensor"])))
        assert all(len(v) == 1 for v in by_text.values())
    longest = max(got, key=lambda r: r["n_frames"])
    read = audio.read_tensors(bytes(longest["tensor"]))
    assert read.num_rows == -(-longest["n_frames"] // audio.PATCH) and read.column("log_mel").type.shape == [audio.PATCH, audio.MELS]
    assert audio.extract(audio.stored(no_docs)).count() == 0


def test_resampling_keeps_a_low_tone_and_drops_a_high_one():
    t = np.arange(16000) / 16000
    low, high = (audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32), 1, 2)[200:-200] for f in (500, 7000))
    assert abs(low.std() - 2**-0.5) < 0.03 and high.std() < 0.05
    assert len(audio.resample(np.zeros(441, np.float32), 80, 441)) == 80


def test_log_mel_against_sums():
    rng = np.random.default_rng(3)
    signal = rng.normal(size=audio.FRAME + 3 * audio.HOP).astype(np.float32)
    got, energy = audio.log_mel(signal)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (k * mel(audio.TARGET / 2) / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    assert len(got) == 4
    for frame in range(4):
        x = [float(v) * (0.5 - 0.5 * math.cos(2 * math.pi * k / (audio.FRAME - 1))) for k, v in enumerate(signal[frame * audio.HOP : frame * audio.HOP + audio.FRAME])]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * n / audio.FRAME) for n, v in enumerate(x))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        for m in range(audio.MELS):
            low, middle, high = edges[m : m + 3]
            weight = lambda f, low=low, middle=middle, high=high: max(0.0, min((f - low) / (middle - low), (high - f) / (high - middle)))
            want = math.log(sum(p * weight(k * audio.TARGET / audio.FRAME) for k, p in enumerate(power)) + 1e-6)
            assert abs(got[frame, m] - want) < 0.01
        assert abs(energy[frame] - 10 * math.log10(sum(power) / audio.FRAME + 1e-9)) < 0.01


def test_resampling_against_sums():
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    for up, down in ((1, 2), (80, 441), (3, 2)):
        n = audio.TAPS * up
        t = [k - (n - 1) / 2 for k in range(n)]
        cut = min(1 / up, 1 / down)
        h = [up * cut * (math.sin(math.pi * cut * v) / (math.pi * cut * v) if v else 1) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1))) for k, v in enumerate(t)]
        stuffed = [0.0] * (len(x) * up)
        stuffed[::up] = x.tolist()
        want = [sum(h[k] * stuffed[at - k] for k in range(n) if at - k >= 0) for at in range(0, len(stuffed), down)]
        assert np.allclose(audio.resample(x.astype(np.float32), up, down), want, atol=1e-3)


def test_hysteresis_holds_a_segment_open():
    energy = np.array([0, 0, 5, 2, 2, 0, 0, 0, 2, 0], float)
    assert audio.segments(energy) == [(2, 5)] and audio.segments(np.zeros(4)) == []


def test_held_out_languages(spark, sf_dir, odd_docs, no_docs):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    scored = langid.predict(docs, model).where(langid.held_out() & F.col("lang").isNotNull())
    assert scored.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = {r["doc_id"]: r for r in langid.predict(odd_docs.where("doc_id is not null"), model).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (3, 4, 7, 11)) and 0 <= odd[1]["score"] <= 1
    assert langid.predict(no_docs, langid.train(no_docs)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, langid.train(no_docs)).collect()} == {"und"}


def plain_buckets(text):
    """Buckets of the 1- to 3-grams, gram by gram: a polynomial of the code points, mixed, 16 bits of it."""
    chars = [ord(c) if "a" <= c <= "z" or (c >= "\u00c0" and c not in "\u00d7\u00f7") else 32 for c in text.lower()]
    out = []
    for n in (1, 2, 3):
        for at in range(len(chars) - n + 1):
            h = 0
            for c in chars[at : at + n]:
                h = (h * 16777619 + c * 2654435761) % (1 << 32)
            h ^= h >> 15
            out.append((h * 2246822507 % (1 << 32)) >> 16)
    return out


def plain_bayes(rows, texts):
    """Naive Bayes with dict counts: language and posterior probability of each text; rows are (id, text, lang)."""
    learned = [(t, lang) for d, t, lang in rows if t is not None and lang is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2)]
    counts, docs = {}, {}
    for text, lang in learned:
        docs[lang] = docs.get(lang, 0) + 1
        own = counts.setdefault(lang, {})
        for b in plain_buckets(text):
            own[b] = own.get(b, 0) + 1
    whole = {lang: sum(own.values()) + 0.5 * 65536 for lang, own in counts.items()}
    out = []
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        score = {lang: math.log(docs[lang] / len(learned)) for lang in sorted(docs)}
        for b in plain_buckets(text):
            for lang in score:
                score[lang] += math.log((counts[lang].get(b, 0) + 0.5) / whole[lang])
        best = max(score, key=score.get)
        out.append((best, 1 / sum(math.exp(x - score[best]) for x in score.values())))
    return out


@pytest.mark.parametrize("block", [10, 500_000])
def test_languages_against_plain_counts(spark, sf_dir, odd_docs, monkeypatch, block):
    """With blocks of 10 characters every text spans many; no gram at their edges is lost or counted twice."""
    monkeypatch.setattr(langid, "BLOCK", block)
    docs = table(spark, sf_dir, "documents").where("n_chars < 2000").select("doc_id", "text", "lang").unionByName(odd_docs.select("doc_id", "text", "lang"))
    rows = [tuple(r) for r in docs.collect()]
    model = langid.train(docs)
    monkeypatch.setattr(langid, "GATHERED", 5000)
    for got, want in zip(model.predict(t for _, t, _ in rows), plain_bayes(rows, [t for _, t, _ in rows]), strict=True):
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-3)
    assert [sorted(np.concatenate(list(langid.blocks(t)))) for t in ("a \u0130\u03a3 \u00d7 bcdefghijklmnop" * 3,)] == [sorted(plain_buckets("a \u0130\u03a3 \u00d7 bcdefghijklmnop" * 3))]


def test_language_columns_of_clashing_names(spark, odd_docs):
    model = langid.train(odd_docs)
    got = langid.predict(odd_docs.withColumn("_text", F.lit("kept")).withColumn("score", F.lit("x")), model)
    assert got.columns.count("score") == 1 and {r["_text"] for r in got.collect()} == {"kept"} and got.count() == odd_docs.count()


def test_queries_are_registered():
    names = queries.queries()
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark, sf_dir, odd_docs):
    for start in (table(spark, sf_dir, "documents"), odd_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = materialize(stage(spark, docs, sf_dir), "test-stage")
            assert after.columns == start.columns and 0 < after.count() <= docs.count(), name
            docs = after
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_needs_no_lang_column_for_prediction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    blind = langid.predict(docs.withColumn("lang", F.lit("xx")), model).select("doc_id", "lang_pred")
    assert sorted(map(tuple, blind.collect())) == sorted(map(tuple, langid.predict(docs, model).select("doc_id", "lang_pred").collect()))


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_binary_lengths(n):
    parts = packing.binary_lengths(n, 1024)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
