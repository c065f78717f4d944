"""Reciprocal-rank fusion of a dense and a keyword ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import names_identifier
from ..session import written
from .keyword import light, top


def gate(keyword: DataFrame, dense: DataFrame, queries: DataFrame) -> DataFrame:
    """Keyword hits of queries that name an identifier or that have no dense hits in the source.

    Whether a query names one is known from its text; only the (query, source) pairs that dense search found are joined.
    """
    named = queries.select("query_id", names_identifier(F.col("query")).alias("__named"))
    near = dense.select("query_id", "source", F.lit(True).alias("__near")).distinct()
    joined = keyword.join(light(named), "query_id").join(light(near), ["query_id", "source"], "left")
    return joined.where(F.col("__named") | F.col("__near").isNull()).drop("__named", "__near")


def fuse(dense: DataFrame, keyword: DataFrame, n=10, known: DataFrame | None = None) -> DataFrame:
    """(query_id, source, chunk_id, rrf_score, pos) of the n best of each source; both rankings have ``pos`` from 0.

    Ties go to the better dense rank (none last), then keyword rank, then id. With ``known`` ids, rows that are not known
    go after the cut, so fewer than n may stay. ``n`` may be a column of the source.
    """
    key = ["query_id", "source", "chunk_id"]
    d, k = dense.select(*key, F.col("pos").alias("d")), keyword.select(*key, F.col("pos").alias("k"))
    both = d.join(k, key, "full_outer")
    score = F.coalesce(1.0 / (LIMITS.rrf_k + F.col("d")), F.lit(0.0)) + F.coalesce(LIMITS.keyword_weight / (LIMITS.rrf_k + F.col("k")), F.lit(0.0))
    best = top(both.withColumn("rrf_score", F.round(score, 12)), n, F.desc("rrf_score"), F.asc_nulls_last("d"), F.asc_nulls_last("k"), F.asc("chunk_id"), by=("query_id", "source"))
    best = best.select(*key, "rrf_score", "pos")
    return best if known is None else _those_known(written(best), known)


def _those_known(best: DataFrame, known: DataFrame) -> DataFrame:
    """The best hits whose ids are known; ids are cut to those of the hits before they are moved."""
    ids = known.select("chunk_id").join(light(best.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return best.join(ids, "chunk_id", "left_semi").select(*best.columns)


def with_rows(hits: DataFrame, chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Hits with fqn, class_name, method_name and body of their chunk; of a chunk that the store lacks, with those the index kept.

    Hits are as few as the queries ask for and are written once; both sides are cut to their ids before they are joined, so
    no text of another chunk is moved. A hit that neither side has goes.
    """
    columns = ("fqn", "class_name", "method_name", "body")
    hits = written(hits)
    some = light(hits.select("chunk_id").distinct())
    stored = chunks.select("chunk_id", F.struct(*columns).alias("s")).join(some, "chunk_id", "left_semi")
    kept = indexed.select("chunk_id", F.struct(*columns).alias("i")).join(some, "chunk_id", "left_semi")
    joined = hits.join(stored, "chunk_id", "left").join(kept, "chunk_id", "left")
    return joined.where(F.col("s").isNotNull() | F.col("i").isNotNull()).withColumn("__row", F.coalesce("s", "i")).select(*hits.columns, "__row.*", F.col("s").isNull().alias("from_index"))
