"""Mixing: targets against plain water filling, and the rounding's guarantees."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.mixing import mix, mixed_rows, pivot


def fill(sizes, limit=3.0):
    """Iterated resharing, plainly."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), {}, {}
    while True:
        left = [s for s in order if s not in full]
        level = (total - sum(full.values())) / max(sum(weight[s] for s in left), 1)
        out = full | {s: level * weight[s] for s in left}
        over = [s for s in left if out[s] > limit * sizes[s] + 1e-9]
        if not over:
            return out
        full |= {s: limit * sizes[s] for s in over}


def docs_of(seed, sources, n):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.paretovariate(0.9) * 8)), rng.choice(sources)) for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = docs_of(1, ["b", "a", "ü", None, "tiny", "c", "c", "c", "c"], 1500)
    rows = [(i, t if s != "tiny" or i % 7 == 0 else "one", s) for i, t, s in rows] + [(-1, None, "none"), (-2, "", "none"), (5, rows[5][1], rows[5][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))


def test_targets_and_sums(corpus):
    rows, docs = corpus
    got = mix(docs, block_rows=100).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    sizes["none"] += 0
    want = fill(dict(sizes))
    taken, largest = collections.Counter(), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 3 * r.size
        assert r.copies in (int(want[r.source] / max(sizes[r.source], 1)), int(want[r.source] / max(sizes[r.source], 1)) + 1, 0, 3)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_reruns_agree_however_partitioned(corpus):
    _, docs = corpus
    key = lambda r: (str(r.doc_id), r.taken)
    assert sorted(map(key, mix(docs, block_rows=50).collect())) == sorted(map(key, mix(docs.repartition(7), block_rows=50).collect()))


def test_pivot_keeps_expectation_and_sum():
    rng = np.random.default_rng(1)
    x, size = np.full(40, 0.3), np.array(sorted(rng.integers(1, 50, 40), reverse=True), float)
    mean, runs = np.zeros(40), 3000
    for _ in range(runs):
        out = pivot(x, size, rng, False)
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and abs((out * size).sum() - (x * size).sum()) < 1e-6
        mean += out
    assert np.abs(mean / runs - 0.3).max() < 0.06
    assert set(pivot(x, size, rng, True)) <= {0.0, 1.0}
    assert pivot(np.array([0.5]), np.array([3.0]), rng, False)[0] == 0.5 and not len(pivot(np.zeros(0), np.zeros(0), rng, True))


def test_rows_are_repeated(corpus):
    _, docs = corpus
    extra = docs.withColumn("lang", F.lit("x"))
    got = mixed_rows(extra)
    assert got.columns == extra.columns
    counts = collections.Counter((r.doc_id, r.source) for r in got.collect())
    assert counts and max(counts.values()) <= 6
    assert not any(s == "none" for _, s in counts)
    assert mixed_rows(extra.limit(0)).count() == 0 and mix(extra.limit(0)).count() == 0


def test_equal_rows_share_their_copies(spark, monkeypatch):
    """A third of all rows are one row: no block holds them, and they are taken evenly."""
    from corvane.llm import mixing

    rows = [(7, "one two three", "a")] * 30_000 + [(7, "other", "a")] * 3 + [(i, "w " * (i % 9), "b" if i % 2 else None) for i in range(100, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks, real = [], mixing._round
    monkeypatch.setattr(mixing, "_round", lambda frame, last, seed: (blocks.append(frame.groupBy("source", "__block").count().agg(F.max("count")).first()[0]), real(frame, last, seed))[1])
    got = mix(docs.repartition(5), block_rows=100).collect()
    assert len(got) == len(rows) and max(blocks) < 200
    mine = collections.Counter(r.copies for r in got if r.doc_id == 7 and r.size == 3)
    target = next(r.target for r in got if r.doc_id == 7)
    assert len(mine) <= 2 and max(mine) - min(mine) <= 1 and abs(sum(r.taken for r in got if r.doc_id == 7) - target) <= 3
    again = mix(docs.repartition(3), block_rows=100).collect()
    key = lambda r: (r.doc_id, r.size, str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
