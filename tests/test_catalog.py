"""Every query of the catalog against its SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from corvane.plans import catalog

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = Path(FOLDER, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, FOLDER)
    got = frame.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, got) == rows(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "chunk_id", "score", "pos"]


def test_plans(spark):
    """Ranked heads are pruned before their shuffle and prefixes reach the scan."""

    def plan(name):
        return catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan("dedup_per_key")
    assert "StringStartsWith" in plan("prefix_filter")
    assert "BatchEvalPython" not in plan("bm25_topk") and "ArrowEvalPython" not in plan("bm25_topk")


def test_stored_index_follows_its_tables(spark, tmp_path):
    """An index is read again while its tables stay as they are, and written anew when they change."""
    small = spark.createDataFrame([(1, "door gate", "en", "src1", 9), (2, "door", "en", "src1", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "u", "<h1>x</h1>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    small.write.parquet(str(tmp_path / "documents.parquet"))
    count = lambda: catalog.stored_index(spark, str(tmp_path)).blocks.where("term = 'door'").agg({"n": "sum"}).first()[0]
    assert count() == 2
    held = dict(catalog._WRITTEN)
    assert count() == 2 and held == catalog._WRITTEN
    small.where("doc_id = 2").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert count() == 1 and len(catalog._WRITTEN) == len(held) + 1
