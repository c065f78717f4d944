"""What dense search holds as tables grow."""

import numpy as np
from corvane.operators import dense
from pyspark.sql import functions as F


def test_tiles_are_of_fixed_size(spark, monkeypatch):
    """Products are made tile by tile, whatever the batch; hits are the nearest, ties included, and rows without a length have none."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3 if i % 11 else None) for i in range(300)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, label int").repartition(2)
    asked = vectors.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = lambda: sorted(map(tuple, dense.vector_search(vectors, asked, 7).select("query_id", "chunk_id", "similarity", "pos").collect()))
    whole = got()
    monkeypatch.setattr(dense, "STEP_QUERIES", 4)
    monkeypatch.setattr(dense, "STEP_ROWS", 5)
    assert got() == whole
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if any(v)}
    for q in (r.query_id for r in asked.collect()):
        best = sorted((-round(float(unit[q] @ u), 9), i) for i, u in unit.items())[:7] if q in unit else []
        assert [r[1] for r in sorted((r for r in whole if r[0] == q), key=lambda r: r[3])] == [i for _, i in best]


def test_recall_without_pairs(spark):
    """Recall by groups is that of all relevant pairs, which are not made; a null group has none."""
    labels = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(60)], "chunk_id long, group int")
    asked = labels.where("chunk_id % 4 = 0").withColumnRenamed("chunk_id", "query_id")
    found = asked.select("query_id").crossJoin(spark.range(12).select(F.col("id").alias("pos"))).select("query_id", "pos", ((F.col("query_id") + F.col("pos") * 5) % 60).alias("chunk_id"))
    relevant = asked.join(labels, "group").select("query_id", "chunk_id")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(dense.recall_of_groups(found, labels, asked, 10)) == rows(dense.recall_at(found, relevant, 10))
