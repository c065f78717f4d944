"""Shaping of ranked lists: stable sorts, caps for each class, quotas for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS


def renumber(hits: DataFrame, *order) -> DataFrame:
    """``pos`` from 0 in an order within each query."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def rerank(hits: DataFrame) -> DataFrame:
    """Best score first; equal ones keep their order."""
    return renumber(hits, F.desc("rrf_score"), F.asc("pos"))


def cut(hits: DataFrame, n: int) -> DataFrame:
    return hits.where(F.col("pos") < n)


def first_per_key(hits: DataFrame, key: str = "fqn", n: int = LIMITS.per_class) -> DataFrame:
    """The first n hits of each key within a query; hits without a key all stay.

    Two branches, so that the ranked one is pruned to n a group before its shuffle.
    """
    free = hits.where(F.col(key).isNull() | (F.col(key) == ""))
    held = hits.where(F.col(key).isNotNull() & (F.col(key) != ""))
    held = held.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", key).orderBy("pos"))).where(F.col("__rn") <= n).drop("__rn")
    return held.unionByName(free)


def with_slots(hits: DataFrame, limit: int, slots: tuple[tuple[str, int], ...] = LIMITS.slots) -> DataFrame:
    """The first hits of each source by quota, source after source, then the others in order, cut at ``limit``."""
    rank = F.lit(len(slots))
    quota = F.lit(0)
    for i, (source, n) in enumerate(slots):
        rank = F.when(F.col("source") == source, F.lit(i)).otherwise(rank)
        quota = F.when(F.col("source") == source, F.lit(n)).otherwise(quota)
    ranked = hits.where(F.col("chunk_id").isNotNull()).withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("pos")))
    placed = ranked.withColumn("__free", F.col("__rn") > quota).withColumn("__group", F.when(F.col("__free"), F.lit(len(slots))).otherwise(rank))
    return cut(renumber(placed, "__group", "pos").drop("__rn", "__free", "__group"), limit)


def promote(hits: DataFrame, boosted: DataFrame) -> DataFrame:
    """Boosted hits (query_id, chunk_id, rrf_score, ord) first, in their order, each once; then the others in theirs."""
    first = boosted.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("ord"))).where("__rn = 1")
    rest = hits.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    one = first.select("query_id", "chunk_id", "rrf_score", F.lit(0).alias("__part"), F.col("ord").cast("long").alias("pos"))
    two = rest.select("query_id", "chunk_id", "rrf_score", F.lit(1).alias("__part"), F.col("pos").cast("long").alias("pos"))
    return renumber(one.unionByName(two), "__part", "pos", "chunk_id").drop("__part")
