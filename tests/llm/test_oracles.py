"""Corpus queries against their SQL, on the smallest tables and on planted personal data."""

from __future__ import annotations

import duckdb
import pytest

from corvane.llm import queries

from .test_pii import TEXTS, disclosure_corpus

FOLDER = "/root/testdata/sf0.001"


def same(frame, con, sql):
    want = con.sql(sql)
    assert sorted(frame.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in frame.columns]
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    same(queries.queries()[name](spark, FOLDER), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_planted(spark, tmp_path, name):
    rows = [(i, t, "en", f"src{i % 4}", None) for i, t in disclosure_corpus()] + [(1000 + i, t, None, None, None) for i, t in enumerate(TEXTS) if t is None or len(t) < 9000]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.queries()[name](spark, str(tmp_path)), con, queries.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
