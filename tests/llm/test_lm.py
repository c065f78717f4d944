"""Language-model scores against plain Python, and the trie against a dictionary."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lm
from corvane.llm.queries import op10_lm_scoring


def plain(rows, trained):
    """(n_tokens, n_known, N, base, score) of each (id, text)."""
    words = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    types, after, deep = collections.Counter(), collections.Counter(), collections.Counter()
    for w, yes in zip(words, trained, strict=True):
        if yes:
            one.update(w)
            two.update(zip([b"", *w], w, strict=False))
            three.update(zip([b"", *w], w, w[1:], strict=False))
    for v, _ in two:
        types[v] += 1
    for (u, v, _), c in three.items():
        after[u, v] += c
        deep[u, v] += 1
    n, distinct, d = sum(one.values()), len(one), lm.DISCOUNT
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (distinct + 1))
    out = []
    for w in words:
        score, line = 0.0, [b"", *w]
        for i, x in enumerate(w):
            v = line[i]
            p = max(two[v, x] - d, 0) / one[v] + d * types[v] / one[v] * p1(x) if one[v] else p1(x)
            if i and after[line[i - 1], v]:
                h = (line[i - 1], v)
                p = max(three[(*h, x)] - d, 0) / after[h] + d * deep[h] / after[h] * p
            score += math.log10(p)
        out.append((len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return out


def same(got, want, share=0.01):
    """Counts and base as they are; the score up to a share of itself, as codes of rare n-grams after frequent contexts round."""
    return got[:3] == want[:3] and math.isclose(got[3], want[3], rel_tol=1e-9, abs_tol=1e-9) and abs(got[4] - want[4]) <= share * abs(want[4])


def test_every_document_of_a_larger_table(spark, monkeypatch):
    """Within 1 % of the exact model, and equal for other shards, words dealt out and partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trained = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    want = dict(zip([i for i, _ in rows], plain(rows, trained), strict=True))
    frame = docs.withColumn("yes", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)
    score = lambda d: {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.lm_scores(d, d["yes"]).collect()}
    first = score(frame)
    assert len(first) == len(rows) and all(same(first[i], want[i]) for i in want) and sum(same(first[i], want[i], 0.002) for i in want) > 0.95 * len(rows)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(lm, "HOT_SHARE", 0.02)
    monkeypatch.setattr(lm, "PACK_TOKENS", 60_000)
    other = score(frame.repartition(5))
    assert all(other[i][:3] == first[i][:3] and math.isclose(other[i][4], first[i][4], rel_tol=1e-9) for i in want)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    got = {r.doc_id: r for r in op10_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    want = plain(rows, [not h for h in out])
    for (i, _), h, w in zip(rows, out, want, strict=True):
        r = got[i]
        assert r.held_out == h and same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), w)
    held = [w for h, w in zip(out, want, strict=True) if h]
    assert sum(w[4] for w in held) > sum(w[3] for w in held)  # the model beats single words on texts it has not seen


@pytest.mark.parametrize("hot", [[], [b"the", b"a"], [b"", b"the"]])
def test_placing_changes_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "frequent_contexts", lambda docs, rows: hot)
    rows = [(i, "the cat the dog A a the" if i % 3 else f"a bird w{i} the a") for i in range(40)] + [(100, None), (101, ""), (102, "the the"), (102, "the the"), (103, "unseen words")]
    trained = [i != 103 for i, _ in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.lm_scores(frame, F.col("doc_id") != 103).collect())
    want = sorted((i, *w) for (i, _), w in zip(rows, plain(rows, trained), strict=True))
    assert len(got) == len(want) and all(g[0] == w[0] and same(g[1:], w[1:]) for g, w in zip(got, want, strict=True))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(none, F.lit(True)).count() == 0
    one = lm.lm_scores(spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string"), F.lit(None).cast("boolean")).collect()
    assert len(one) == 2 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in one)
    long = spark.createDataFrame([(1, "word other " * 60_000)], "doc_id long, text string")
    assert lm.lm_scores(long, F.lit(True)).first().n_tokens == 120_001


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1 << 50), (1000, 5000), (1000, 1 << 60), (5000, 1 << 40)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        data = lm.EliasFano.build(values)
        seq, end = lm.EliasFano.load(data, 0)
        assert end == len(data) and (seq.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 200).astype(np.uint64)])
        got, equal = seq.successor(asked, np.zeros(len(asked), np.int64), np.full(len(asked), n))
        assert (got == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()
    dense = np.arange(10_000, dtype=np.uint64) * np.uint64(3)
    assert len(lm.EliasFano.build(dense)) < 12_000  # little over a byte a number


def test_trie(tmp_path):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(c), int(w)) for c, w in zip(rng.integers(0, 60, 4000), rng.integers(0, 1 << 40, 4000) // (1 << 28) << 28, strict=True)})
    triples = sorted({(int(p), int(w)) for p, w in zip(rng.integers(0, len(pairs), 9000), rng.integers(0, 1 << 32, 9000) >> 20 << 20, strict=True)})
    present = sorted({c for c, _ in pairs})
    codes, weights, leaves = (np.where((x := rng.integers(1, 256, n)) == 255, 255 | rng.integers(0, 1 << 32, n) << 8, x).astype(np.uint64) for n in (len(pairs), len(pairs), len(triples)))
    path = str(tmp_path / "levels")
    lm.Trie.write(path, np.array(present), np.array([(present.index(c) << 40) | w for c, w in pairs], np.uint64), np.array([(p << 32) | w for p, w in triples], np.uint64), codes, weights, leaves)
    trie = lm.Trie(path)
    asked = pairs + [(c, w + 1) for c, w in pairs] + [(99, 5), (0, 0)]
    got = trie.find(np.array([c for c, _ in asked], np.uint64), np.array([w for _, w in asked], np.uint64))
    place = {p: i for i, p in enumerate(pairs)}
    assert got.tolist() == [place.get(k, -1) for k in asked]
    assert [x.tolist() for x in trie.at(got[: len(pairs)])] == [codes.tolist(), weights.tolist()] and trie.at(np.array([-1]))[0].tolist() == [0]
    below = triples + [(p, w + 1) for p, w in triples] + [(-1, 7)]
    known = dict(zip(triples, leaves.tolist(), strict=True))
    assert trie.follow(np.array([p for p, _ in below]), np.array([w for _, w in below], np.uint64)).tolist() == [known.get(k, 0) for k in below]
    trie.close()


def test_codes():
    """Ratios of small counts are exact, frequent n-grams to one part in two thousand, the rest to their bin."""
    rng = np.random.default_rng(1)
    whole = np.concatenate([rng.integers(1, 16, 500), rng.integers(16, 1_000_000, 3000)])
    part = np.minimum(rng.integers(1, 400, 3500), whole)
    value, ratio = (part - 0.75) / whole, lambda c, n: (c - 0.75) / n
    codes = lm.coded(part, whole, value, part >= lm.FINE_COUNT)
    got = lm.decoded(codes, ratio)
    assert (got[whole <= 15] == value[whole <= 15]).all() and (codes > 0).all()
    fine = (whole > 15) & (part >= lm.FINE_COUNT)
    assert np.allclose(got[fine], value[fine], rtol=5e-4) and np.abs(np.log2(got / value))[value > 2.0**-20].max() <= 0.26
    assert lm.coded(np.array([0]), np.array([5]), np.array([0.0]), np.array([True])).tolist() == [0] and lm.decoded(np.zeros(1, np.uint64), ratio).tolist() == [0.0]
    reader = lm._Reader(lm._pack_codes(codes) + lm._pack_codes(codes[:0]))
    assert (reader.codes(len(codes)) == codes).all() and len(reader.codes(0)) == 0
