import hashlib
import random
from collections import Counter

import pytest

from tracewright.llm import suffix
from tracewright.llm.common import table

SCHEMA = "doc_id long, text string"


def removed(docs):
    """Every 200-byte string of every document counted."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def check(spark, docs):
    got = suffix.digest(suffix.remove_repeats(spark.createDataFrame(docs, SCHEMA)))
    want = removed(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    return sum(r[2] for r in want)


def passages(n, seed=5):
    """Documents that share passages of many lengths, in places that differ by document."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    shared = [text(k) for k in (150, 199, 200, 201, 260, 700)]
    return [(k, text(rng.randrange(0, 90)) + rng.choice(shared) + text(rng.randrange(0, 300)) + rng.choice(shared)) for k in range(n)]


def test_against_all_windows(spark, sf_dir):
    assert check(spark, [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]) > 0


def test_shared_passages(spark):
    assert check(spark, passages(60)) > 0


@pytest.mark.parametrize("text", ["a" * 900, "ab" * 500, ("x" * 250 + "y") * 3])
def test_periodic_texts(spark, text):
    check(spark, [(1, text), (2, text[:210]), (3, "z" + text[:300])])


def test_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    assert check(spark, passages(60)) > 0


def test_texts_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 700)
    suffix._powers.cache_clear()
    docs = passages(30)
    plain = [list(suffix.pieces(t.encode())) for _, t in docs]
    assert all(sum(w for _, _, w in p) == max(0, len(t.encode()) - 199) for p, (_, t) in zip(plain, docs, strict=True))
    suffix._powers.cache_clear()


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = suffix.digest(suffix.remove_repeats(odd_docs))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == removed(docs)
    assert suffix.remove_repeats(no_docs).count() == 0


def test_tree_groups_are_maximal_with_all_occurrences():
    rng = random.Random(3)
    core = bytes(rng.choices(b"abcd", k=240))
    bodies = [b"1" + core + b"2", b"3" + core + b"4", b"5" + core[:220] + b"6"]
    found = {}
    for piece, offset, length, group in suffix.repeat_tree(bodies):
        found.setdefault((group, length), set()).add((piece, offset))
    assert {length for _, length in found} == {240, 220}
    assert next(v for (_, n), v in found.items() if n == 240) == {(0, 1), (1, 1)}
    assert (2, 1) in next(v for (_, n), v in found.items() if n == 220)
