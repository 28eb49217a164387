"""Spelling variants, fill-in-middle and exact dedup against versions written from their definitions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tracewright.llm import exact, infill, queries, spelling


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def plain_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    # Two words are near if they share what is left of each when one place is blanked (same length) or taken out of the longer one.
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes["r", k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, _, rest), group in holes.items():
        for w in group:
            near[w] |= group - {w}
        if rest in n:
            for w in group:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def told(df):
    return sorted((w, form or "", root, n, near, form_n or 0) for w, form, root, n, near, form_n in rows_of(df))


@pytest.mark.parametrize("part", [5000, 3])
def test_variants_equal_all_pairs(spark, sf_dir, part):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Repeated texts under other ids make frequent words and, by the hash, their variants.
    more = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text").unionByName(docs.select("doc_id", "text"))
    found = told(spelling.variants(more, part=part))
    assert found == plain_variants([tuple(r) for r in more.collect()])
    assert any(x[1] for x in found) and any(x[4] > 1 for x in found)


def test_variants_follow_chains_and_accents(spark):
    words = {"straße": 1, "straßen": 5, "strassen": 30, "strasse": 200, "strassés": 5, "abcdef": 5, "abcdeg": 5, "ÀBCDEF": 25, "bacdef": 9}
    rows = [(1000 * k + i, word.upper() if i % 2 and word.isascii() else word) for k, (word, n) in enumerate(words.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = told(spelling.variants(df))
    assert found == plain_variants(rows)
    assert {x[0]: x[2] for x in found}["strassen"] == "strasse"


def test_one_edit_is_exact():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("abc") for _ in range(len(a) + rng.randint(0, 1)))
        if len(a) == len(b):
            want = sum(x != y for x, y in zip(a, b, strict=True)) == 1
        else:
            want = any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
        assert spelling.one_edit(a, b) == want


def test_trie_finds_what_all_pairs_find():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abceno") for _ in range(rng.randint(6, 7))) for _ in range(1500)})
    counts = spelling.vectors(words)
    branch = spelling._branch(counts)
    want = {(a, b) for a in words for b in words if (len(b) == len(a) + 1 or len(a) == len(b) and a < b) and spelling.one_edit(a, b)}
    got = set()
    groups = defaultdict(list)
    for k in range(len(words)):
        groups[tuple(branch[k].tolist())].append(k)
    steps = spelling._steps()
    for key, members in groups.items():
        own = [words[k] for k in members]
        trie = spelling.Trie(own, counts[members])
        probes = [k for k in range(len(words)) if any((branch[k] + s == key).all() for s in steps)]
        for p, w in trie.search([words[k] for k in probes], counts[probes], np.array(key, "<i4")):
            pair = (words[probes[p]], own[w])
            pair = pair if len(pair[0]) < len(pair[1]) else tuple(sorted(pair))
            assert pair not in got
            got.add(pair)
    assert got == want


def test_variants_of_odd_tables(spark, odd_docs, no_docs):
    assert told(spelling.variants(odd_docs)) == plain_variants([("" if r.doc_id is None else r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert rows_of(spelling.variants(no_docs)) == []


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (-1 if doc_id is None else doc_id, len(units), "plain", -1, -1, digest(text), digest(text))
    spm = h[3] % 100 < 50
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (-1 if doc_id is None else doc_id, len(units), "spm" if spm else "psm", len(prefix), len(middle), digest(out), digest(text))


def filled(df):
    return sorted((-1 if i is None else i, n, form, -1 if p is None else p, -1 if m is None else m, a, b) for i, n, form, p, m, a, b in rows_of(df))


def test_infill_equals_plain_version(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = filled(queries.op12_fill_in_middle(spark, sf_dir))
    assert found == sorted(plain_infill(*d) for d in docs)
    assert {x[2] for x in found} >= {"spm", "psm"}


def test_infill_of_odd_texts(spark, odd_docs, no_docs):
    rows = [(k, t) for k, t in enumerate(["\n", "\n\n\n", "a\n\nb", "no break", "é\n𝄞𝄞\nß", "x<P>y\nz", "<M>", "<\nS>\n<P", "<P\n><S\n>", "\r\n\r", ("ligne é\n" * 7000) + "end", "y" * 300_000, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert filled(infill.digest(infill.transform(df))) == sorted(plain_infill(*r) for r in rows)
    assert filled(infill.digest(infill.transform(odd_docs))) == sorted(plain_infill(r.doc_id, r.text) for r in odd_docs.collect())
    assert rows_of(infill.transform(no_docs)) == []


def test_infill_rate_and_columns(spark, odd_docs):
    none = infill.transform(odd_docs, rate=0, keep=["key", "n"])
    assert {r.form for r in none.collect()} == {"plain"} and none.select("row.key").first()[0] == "k"
    every = infill.transform(odd_docs, spm=100)
    assert "psm" not in {r.form for r in every.collect()}


def test_skip_list_finds_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 64, 1000):
        widths = rng.integers(1, 9, n)
        lanes = infill.SkipList(widths)
        ends = np.concatenate([[0], np.cumsum(widths)])
        assert [lanes.find(k) for k in range(n + 1)] == ends.tolist()
        assert n < 64 or len(lanes.lanes) > 2


def plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[ \t\n\x0b\f\r]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for content, members in groups.items():
        best, seen = min(members), False
        for m in members:
            kept = m == best and not seen
            seen |= kept
            out.append((-1 if m[1] else m[2], -1 if best[1] else best[2], len(members), kept, hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out)


def copies(df):
    return sorted((-1 if i is None else i, -1 if k is None else k, n, kept, h) for i, k, n, kept, h in rows_of(df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")))


def texts(n=400):
    rng = random.Random(9)
    base = ["same text", "same  text ", "other\ttext", "", None, " ", "x" * 5000, "ünï côdé"]
    return [(rng.choice([k, k, -k, 1 << 62, -(1 << 63)]), rng.choice(base) if k % 3 else "hot " * (1 + k % 2)) for k in range(n)] + [(None, "alone"), (None, "alone"), (7, "alone")]


@pytest.mark.parametrize("share", [1000, 2])
def test_exact_equals_plain_version(spark, sf_dir, monkeypatch, share):
    monkeypatch.setattr(exact, "HOT_SHARE", share)
    assert copies(queries.op13_exact_dedup(spark, sf_dir)) == plain_exact(documents(spark, sf_dir))
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(7)
    assert copies(exact.verdicts(df)) == plain_exact(texts())


def test_exact_under_a_digest_that_collides(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(5)
    weak = exact.verdicts(df, digest=lambda content: F.length(content).cast("string"), salts=3)
    assert copies(weak) == plain_exact(texts())


def test_exact_of_odd_tables(spark, odd_docs, no_docs):
    assert copies(exact.verdicts(odd_docs)) == plain_exact([(r.doc_id, r.text) for r in odd_docs.collect()])
    left = exact.dedup_exact(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == len({re.sub(r"\s", "", r.text or "") for r in odd_docs.collect()})
    assert rows_of(exact.verdicts(no_docs)) == []


def test_exact_runs_without_python(spark, sf_dir):
    plan = queries.op13_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_exact_dedup"])
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    path = f"{sf_dir}/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(repr, rows_of(got))) == sorted(map(repr, want.fetchall()))
