"""Dense search: exact cosine top-k, with filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .keyword import top

#: Query vectors that one pass over the rows takes (65,536 of 64 dimensions are 32 MB); queries and rows that a worker multiplies at a
#: time: 512 by 1,024 products are 4 MB, whatever the batches and however many queries there are.
BLOCK_QUERIES, STEP_QUERIES, STEP_ROWS = 65_536, 512, 1_024


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; those of no length become nan."""
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.full_like(rows, np.nan), where=norm > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of doubles; rows of another width, with nulls or null themselves become zeros."""
    out = np.zeros((len(column), width))
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(good)).flatten().cast(pa.float64())
    out[good] = np.nan_to_num(flat.to_numpy(zero_copy_only=False), nan=0.0).reshape(-1, width)
    return out


def vector_search(vectors: DataFrame, queries: DataFrame, n: int = 10, where=None) -> DataFrame:
    """(query_id, chunk_id, similarity, distance, pos): the n nearest rows of each query vector, exactly.

    ``vectors`` has chunk_id and embedding, ``queries`` has query_id and vector. ``where`` is a condition on the rows, kept at the scan.
    Queries are a stated set: blocks of a fixed size go to all rows as one matrix of unit vectors; tiles of fixed size are
    multiplied, and of a task's rows those leave it that are among a query's n best so far, ties included. Rows or queries of no length, or of another width, have no
    similarity. Building the frame collects the queries, block by block.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = (vectors if where is None else vectors.where(where)).select("chunk_id", "embedding")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    query_kind = queries.schema["query_id"].dataType
    keyed = queries.select("query_id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = None
    for k in range(blocks):
        block = keyed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else keyed
        table = block.toArrow()
        width = max((len(v) for v in table.column("vector").to_pylist() if v), default=0)
        ids = np.array(table.column("query_id").to_pylist(), object)
        asked = _unit(_matrix(table.column("vector").combine_chunks(), width)) if width else np.zeros((len(ids), 0))

        def run(batches: Iterator[pa.RecordBatch], asked=asked, width=width) -> Iterator[pa.RecordBatch]:
            best = np.full((len(asked), n), -np.inf)
            for batch in batches:
                for start in range(0, batch.num_rows, STEP_ROWS):
                    part = batch.slice(start, STEP_ROWS)
                    unit = _unit(_matrix(part.column(1), width)) if width else np.zeros((part.num_rows, 0))
                    for at in range(0, len(asked), STEP_QUERIES):
                        near = asked[at : at + STEP_QUERIES] @ unit.T
                        np.round(near, 9, out=near)
                        near[np.isnan(near)] = -np.inf
                        held = best[at : at + len(near)]
                        top_n = np.partition(near, -n, axis=1)[:, -n:] if near.shape[1] > n else near
                        held[:] = np.partition(np.concatenate([held, top_n], axis=1), -n, axis=1)[:, -n:]
                        q, r = np.nonzero((near >= held.min(axis=1)[:, None]) & (near > -np.inf))
                        yield pa.RecordBatch.from_arrays([pa.array(q + at, pa.int32()), part.column(0).take(pa.array(r)), pa.array(near[q, r])], names=["q", "chunk_id", "similarity"])

        scored = rows.mapInArrow(run, f"q int, chunk_id {kind}, similarity double")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids.tolist())], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", query_kind)]))
        part = top(scored, n, F.desc("similarity"), F.asc("chunk_id"), by=("q",)).join(F.broadcast(names), "q").drop("q")
        found = part if found is None else found.unionByName(part)
    return found.select("query_id", "chunk_id", "similarity", "pos").withColumn("distance", 1 - F.col("similarity"))


def recall_at(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of a query's relevant chunks among its first k hits."""
    hits = found.where(F.col("pos") < k).join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return total.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"))


def recall_of_groups(found: DataFrame, groups: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): as ``recall_at``, where all rows of a query's group are relevant: ``groups`` (chunk_id, group), ``asked`` (query_id, group).

    Groups are counted and hits compare their group with their query's, so no pair of a query and a relevant row is made. A
    null group has no rows.
    """
    total = asked.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("rows")), "group").groupBy("query_id").agg(F.sum("rows").alias("total"))
    near = found.where(F.col("pos") < k).select("query_id", "chunk_id").join(asked.distinct(), "query_id")
    hits = near.join(groups, ["chunk_id", "group"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return total.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"))
