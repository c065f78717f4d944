"""Importance resampling: tries and scores against plain Python, the draw, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.resample import WordTrie, bucket_totals, importance_resample, word_states

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    words = WORD.findall(lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, least=20, percent=25, buckets=10_000):
    s, t = Counter(), Counter()
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            into.update(bucket(f, buckets) for f in features(text)[1])
    size, other = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (other + buckets)))) for b in range(buckets)]
    out = {}
    for key, text in docs:
        words, runs = features(text)
        weight = sum(gain[bucket(f, buckets)] for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        out[key] = (len(words), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((k for k, v in out.items() if v[0] >= least), key=lambda k: (-out[k][3], k))
    ranks = {k: i + 1 for i, k in enumerate(able[: percent * len(able) // 100])}
    return {k: (*v[1:], ranks.get(k)) for k, v in out.items()}


def corpus(n, seed=3):
    rng = random.Random(seed)
    pool = ["the", "The", "of", "é", "Straße", "x9", "Q", "long" * 40, "日本語", "a-b", "don't", "É\x7fz", "\x00"] + [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 2, 19, 20, 21, 60, 300])))) for i in range(n)]


def test_matches_plain_python(spark):
    docs = [*corpus(400), (1000, None), (1001, ""), (1002, " \n;;"), (1003, "the of " * 30_000)]
    target = [(1, "w1 w2 the of w3"), (2, None), (3, "日本語 w1 w2 " * 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("clash"), "__words": F.lit(1)})
    got = importance_resample(frame, spark.createDataFrame(target, "item_id long, text string"), limit=300, ranked_rows=50).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == plain(docs, target) and len(got) == len(docs)


def test_placing_and_size_of_the_trie_change_nothing(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string")
    target = spark.createDataFrame(corpus(20, 9), "item_id long, text string")
    one = importance_resample(docs.coalesce(1), target, limit=10_000_000).collect()
    many = importance_resample(docs.repartition(13), target, limit=50, ranked_rows=7).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_empty_tables_ties_and_null_keys(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(5, "a " * 30)] * 6 + [(None, "a " * 30)] * 2, "doc_id long, text string")
    assert importance_resample(none, some).count() == 0 and bucket_totals(none).count() == 0
    got = importance_resample(some, none, percent=50).collect()
    assert len(got) == 8 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert len({r.score for r in got if r.doc_id == 5}) == 1


@pytest.mark.parametrize("text", ["", "ab", "ab cd", "É1 é2 Zz" * 5, "x" * 500 + " " + "y" * 70 + " x", "\x80".encode("latin1").decode("latin1") + "a b"])
def test_states_are_crc32(text):
    words = [w.encode() for w in WORD.findall(lower(text))]
    state, sizes, counts = word_states([text.encode(), b"", b"one"])
    assert state.tolist() == [zlib.crc32(w) for w in [*words, b"one"]] and sizes.tolist() == [len(w) for w in [*words, b"one"]]
    assert counts.tolist() == [len(words), 0, 1]


def test_children_continue_the_state_of_their_parent():
    trie = WordTrie(1 << 30)
    trie.count([b"alpha beta alpha beta " + b"z" * 100 + b" q"])
    words = ["alpha", "beta", "z" * 100, "q"]
    pairs = Counter(zip(["alpha", "beta", "alpha", "beta", "z" * 100], ["beta", "alpha", "beta", "z" * 100, "q"], strict=True))
    assert dict(zip(trie.child_state.tolist(), trie.child_value.tolist(), strict=True)) == {zlib.crc32(" ".join(p).encode()): n for p, n in pairs.items()}
    assert set(trie.state.tolist()) == {zlib.crc32(w.encode()) for w in words} and np.array_equal(np.sort(trie.keys), trie.keys)
