"""Hard negatives against all products, computed plainly."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.negatives import Anchors, Best, hard_negatives, products

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [math.floor(256.0 * float(np.float32(x))) for x in v]


def plain(rows, is_anchor, k=5, n=5):
    fine = [(i, whole(v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, v, y in fine:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, z) for j, w, z in fine)
        for p, j, _ in [s for s in scored if s[2] == y and s[1] != i][:k]:
            window = [s for s in scored if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:n]
            out += [(i, j, r + 1, m, -p, -q) for r, (q, m, _) in enumerate(window)]
    return sorted(out)


def table(n, width, seed, labels=3, spread=0.4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, spread / 2) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def found(frame, **options):
    return sorted(tuple(r) for r in hard_negatives(frame, F.col("vec_id") % 10 == 0, **options).collect())


@pytest.mark.parametrize("block", [3, 10_000])
def test_matches_all_products(spark, block):
    rows = table(700, 24, 1)
    rows += [(1000, None, 1), (1010, [1.0, None] + [0.0] * 22, 1), (1020, [math.nan] * 24, 1), (1030, [math.inf] * 24, 1), (1040, [0.5] * 24, None), (1050, [0.0] * 24, 0), (1060, [], 1), (1070, [0.3] * 5, 2), (1081, [0.3] * 40, 1)]
    rows += [(2000 + i, rows[3][1], i % 2) for i in range(30)]  # ties
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "score": F.lit("x"), "__anchor": F.lit(3)})
    got = found(frame.repartition(5), block=block)
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_hot_label_and_repeated_rows(spark):
    rows = [(i, v, 0 if i % 3 else y) for i, v, y in table(300, 8, 2)]
    rows += rows[40:60]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows, lambda i: i % 10 == 0)


def test_no_anchor_no_rows_one_label(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], SCHEMA)) == []
    assert found(spark.createDataFrame([(i, [1.0], 0) for i in range(30)], SCHEMA)) == []
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).schema.names == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("most", [1, 200, 1 << 14, 1 << 25])
@pytest.mark.parametrize("width", [1, 16, 96])
def test_products_are_exact_and_complete(most, width):
    rng = np.random.default_rng(most + width)
    rows, anchors = rng.integers(-most, most + 1, (90, width)), rng.integers(-most, most + 1, (40, width))
    want = rows @ anchors.T
    low, high = np.quantile(want, 0.7, axis=0).astype(np.int64).astype(float), np.quantile(want, 0.95, axis=0).astype(np.int64).astype(float)
    allowed = rng.random(want.shape) < 0.5
    r, a, score = products(rows, Anchors(anchors), low, high, allowed)
    keep = allowed & (want >= low) & (want <= high)
    assert set(zip(r.tolist(), a.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(keep)), strict=True))
    assert (score == want[r, a]).all()


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.add(np.array([1, 1, 1]), np.array([5, 5, 5]), np.array([9, 3, 7]))
    best.add(np.array([1]), np.array([5]), np.array([1]))
    assert best.id[1].tolist() == [1, 3] and best.held.tolist() == [0, 2]
