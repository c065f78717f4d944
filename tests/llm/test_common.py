"""Helpers: decisions beside the scan, running sums, joins with heavy keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.llm import common as C


@pytest.mark.parametrize("slices", [8192, 1])
def test_decisions(spark, monkeypatch, slices):
    """Every row gets its own decision, with one scan and with several; names that clash are carried along."""
    monkeypatch.setattr(C, "BLOCK_SLICES", slices)
    made = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("__file"), F.lit(1).alias("_metadata"), F.lit(2).alias("__n")).repartition(4)
    rows = C.filed(made)
    assert rows is not made and C.filed(rows) is rows
    decisions = C.located(rows, "doc_id").select("doc_id", F.col("__file").alias("f"), "__at").toDF("doc_id", "__file", "__at").select("__file", "__at", (F.col("doc_id") % 4).cast("int").alias("n")).where("n <> 3")
    got = C.decided(rows, decisions, 3)
    assert got.count() == 3000
    assert got.where(F.col("__n") != F.when(F.col("__all.doc_id") % 4 == 3, 0).otherwise(F.col("__all.doc_id") % 4)).count() == 0
    assert C.decided(rows, decisions.limit(0), 1).where("__n = 0").count() == 3000
    assert got.select("__all.*").columns == made.columns


def test_running_sums(spark):
    frame = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = C.running(frame, [F.col("id").desc()], {"n": F.lit(1), "s": F.col("v")}, 90)
    total, want = 0, {}
    for k, i in enumerate(range(999, -1, -1)):
        total += i % 7
        want[i] = (k + 1, total)
    assert {r["id"]: (r["n"], r["s"]) for r in got.collect()} == want
    assert C.running(frame.limit(0), [F.col("id").asc()], {"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_join(spark, monkeypatch, share, how):
    monkeypatch.setattr(C, "HEAVY_SHARE", share)
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"))
    right = left.where("k is not null and k <> 'k4'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = left.join(right, ["k"], how)
    assert sorted(map(tuple, C.heavy_join(left, right, ["k"], "n", how).select(plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_running_sums_start_no_other_workers(spark, monkeypatch):
    """Rows that the driver hands out as Python objects are read by workers of their own kind, beside those of the operators."""

    def refused(*_, **__):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    got = C.running(spark.range(10), [F.col("id").asc()], {"n": F.lit(1)}, 4)
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 11))


def test_rest_gives_heap_back(spark):
    """Executors (here the driver) collect their whole heap between stages, and a stage asks for it."""
    import corpus_pipeline

    def whole():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())

    before = whole()
    C.rest(spark)
    between = whole()
    assert between > before
    corpus_pipeline.encode(spark, spark.createDataFrame([], "doc_id long, source string, text string"), "")
    assert whole() > between
