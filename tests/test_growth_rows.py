"""What joins of hits move as tables grow."""

from corvane.operators import fusion
from pyspark.sql import functions as F


def test_rows_of_few_hits(spark):
    """Only chunks that were hit are joined: the texts of others are not moved."""
    chunks = spark.createDataFrame([(f"c{i:03}", f"text {i}") for i in range(20)], "chunk_id string, body string")
    full = chunks.withColumns({c: F.lit(None).cast("string") for c in ("fqn", "class_name", "method_name")})
    hits = spark.createDataFrame([(1, "c001", 0), (1, "c002", 1), (1, "gone", 2)], "query_id int, chunk_id string, pos int")
    found = fusion.with_rows(hits, full.where("chunk_id <> 'c002'"), full)
    assert sorted((r.chunk_id, r.from_index) for r in found.collect()) == [("c001", False), ("c002", True)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
