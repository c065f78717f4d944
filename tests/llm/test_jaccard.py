"""The Jaccard join against all pairs in plain Python."""

from __future__ import annotations

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm import jaccard as J
from corvane.llm.components import components


def brute(docs, percent=75, size=5):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = collections.defaultdict(list)
    for n, (_, s) in enumerate(sets):
        met = collections.Counter(m for g in s for m in where[g])
        for g in s:
            where[g].append(n)
        for m, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[m][1]) - both):
                top[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(sets):
        r = find(n)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return collections.Counter((i, len(s), least[find(n)] if s else i) for n, (i, s) in enumerate(sets))


def corpus(seed, groups=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(groups):
        own = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 12, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            rate = rng.choice([0, 0, 0.01, 0.02, 0.04, 0.06])
            w = [rng.choice("abcdefgh") * rng.randint(1, 3) if rng.random() < rate else x for x in own]
            w = w + shared if rng.random() < 0.5 else w
            w = w[: int(len(w) * 0.8)] if rng.random() < 0.2 else w
            out.append((len(out), " ".join(w)))
    return out


EDGES = [(9001, None), (9002, ""), (9003, " \n"), (9004, "a b"), (9005, "A  B"), (9004, "a b"), (9006, "a b c"), (None, "a b"), (9007, "x " * 40_000), (9008, None), (9008, None)]


@pytest.mark.parametrize(("seed", "share", "block"), [(3, 0.001, 512), (4, 10.0, 8)])
def test_groups(spark, monkeypatch, seed, share, block):
    """With heavy keys dealt out and one block a band, and with none and many small blocks."""
    monkeypatch.setattr(common, "HEAVY_SHARE", share)
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    docs = corpus(seed) + EDGES
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_groups(frame).collect())
    assert got == brute(docs)


def test_threshold_is_exact(spark):
    """Sets of 7 with 6 in common (6/8 = 0.75) are linked, of 7 and 6 with 5 in common (5/8) are not."""
    base = "a b c d e f g h i j k".split()
    docs = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["z"])), (3, " ".join(["q"] + base[1:-1]))]
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute(docs)


def test_one_of_each(spark):
    docs = corpus(5, 25) + EDGES
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("extra", F.col("doc_id"))
    kept = J.one_of_each(frame)
    assert kept.columns == ["doc_id", "text", "extra"]
    groups = brute(docs)
    want = collections.Counter({c for (_, n, c) in groups if n})
    for (i, n, _), k in groups.items():
        if not n:
            want[i] += k
    assert collections.Counter(r.doc_id for r in kept.collect()) == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_groups(none).count() == 0 and J.one_of_each(none).count() == 0
    assert J.jaccard_groups(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().component_id == 1


def test_packs_and_buckets_lose_nothing(monkeypatch):
    """Packed exchange in one process, in small packs with hot shingles: survivors and prefixes cover every linked pair."""
    monkeypatch.setattr(J, "HOT", 4)
    docs = corpus(6)
    docs = [(i, t) for i, t in docs if t]
    sets = {i: J.shingles(t.encode()) for i, t in docs}
    rows, bits = [], 3
    for start in range(0, len(docs), 50):
        part = {J.set_key(sets[i]): sets[i] for i, _ in docs[start : start + 50]}
        rows += list(J._pack(start + 1, list(part.values()), list(part), bits))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    packs = collections.defaultdict(list)
    for group in by.values():
        for r in J._count(pa.Table.from_batches([J._rows(group)])).to_pylist():
            packs[r["key"]].append((r["key"], r["kind"], r["blob"]))
    alive = {}
    for group in packs.values():
        for r in J._survivors(75)(pa.Table.from_batches([J._rows(group)])).to_pylist():
            assert r["node"] not in alive
            alive[r["node"]] = r
    distinct = {J.set_key(s): s for s in sets.values()}
    keys = list(distinct)
    for a in range(len(keys)):
        for b in range(a):
            x, y = distinct[keys[a]], distinct[keys[b]]
            both = len(np.intersect1d(x, y))
            if J.linked(len(x), len(y), both):
                assert set(alive[keys[a]]["prefix"]) & set(alive[keys[b]]["prefix"])


def test_bitmap_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = np.unique(rng.integers(0, 3000, 400).astype(np.uint64)), np.unique(rng.integers(0, 3000, 300).astype(np.uint64))
        bound = J.overlap_bound(J.bitmap(a)[None], J.bitmap(b), np.array([len(a)]), len(b))[0]
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_frequency_codes():
    """Exact below 64, in order above: a shingle of ten million sets comes after one of 64."""
    counts = np.unique(np.concatenate([np.arange(3000), 2 ** np.arange(46), 3 * 2 ** np.arange(45)])).astype(np.int64)
    codes = J.frequency_codes(counts).astype(int)
    assert (codes[:64] == np.arange(64)).all() and (np.diff(codes) >= 0).all()
    assert list(J.frequency_codes(np.array([64, 80, 127, 128, 10**7]))) == [64, 65, 67, 68, 64 + 4 * 17]


def test_frequent_shingles_come_last(monkeypatch):
    """A shingle of 120 sets of three packs, sent once by each, ranks behind one of 20; sets agree on every place."""
    monkeypatch.setattr(J, "HOT", 10)
    draw = np.random.default_rng(2)
    everywhere, often = np.uint64(1 << 24 | 5), np.uint64(1 << 25 | 3)
    rows = []
    for pack in range(3):
        own = draw.integers(1 << 40, 1 << 63, (40, 3)).astype(np.uint64)
        sets = [np.unique(np.append(x, [everywhere, often] if i < (18, 1, 1)[pack] else [everywhere])) for i, x in enumerate(own)]
        rows += list(J._pack(pack + 1, sets, [J.set_key(x) for x in sets], 3))
    buckets, packs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        buckets[r[0]].append(r)
    for group in buckets.values():
        for r in J._count(pa.Table.from_batches([J._rows(group)])).to_pylist():
            packs[r["key"]].append((r["key"], r["kind"], r["blob"]))
    found = [r for group in packs.values() for r in J._survivors(30)(pa.Table.from_batches([J._rows(group)])).to_pylist()]
    ids = [int(x & np.uint64(7)) << 40 | int(x) >> 24 for x in (often, everywhere)]
    assert len(found) == 20 and all([i for i in r["prefix"] if i in ids] == ids[: len(r["prefix"])] for r in found)


@pytest.mark.parametrize("share", [0.001, 10.0])
def test_components(spark, monkeypatch, share):
    """With all nodes dealt out as heavy ones, and with none."""
    monkeypatch.setattr(common, "HEAVY_SHARE", share)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("x", "y"), ("y", "x"), ("z", "x")] + [("hub", f"s{i}") for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({got[f"c{i}"] for i in range(38)}) == 1 and got["x"] == got["y"] == got["z"] == "x" and {got[f"s{i}"] for i in range(50)} == {"hub"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
