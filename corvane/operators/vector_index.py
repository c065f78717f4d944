"""A stored vector index of inverted lists: probes read few of them, and an exact search reads no list that its bound rules out."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .dense import _matrix, _unit
from .keyword import top

#: Rows, about, that centroids are fitted to, and of them those that ask for their neighbours to set the number of probes.
SAMPLE_ROWS, ASKING_ROWS = 50_000, 500
#: Lists at most, sample rows a list at least, rounds of fitting.
MOST_LISTS, ROWS_A_LIST, ROUNDS = 4_096, 8, 12
#: Rows of one file, about: a list of more is dealt over several.
ROWS_A_FILE = 250_000
#: Queries of one pass.
BLOCK_QUERIES = 4_096
#: Rows without a direction (null, of no length, of another width) lie in this list, which nothing probes.
NOWHERE = -1


def centroids_of(unit: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids by spherical k-means; a list that runs empty starts anew at the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(ROUNDS):
        near = unit @ centres.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        empty = np.flatnonzero(np.bincount(at, minlength=lists) == 0)
        if len(empty):
            sums[empty] = unit[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = np.nan_to_num(_unit(sums))
    return centres


def probes_for(unit: np.ndarray, centres: np.ndarray, aim: float, n: int = 10) -> int:
    """The least number of lists in which sample rows find a share ``aim`` of their n nearest of the sample."""
    asked = unit[np.linspace(0, len(unit) - 1, min(ASKING_ROWS, len(unit))).astype(int)]
    near = asked @ unit.T
    nearest = np.argpartition(-near, min(n, near.shape[1] - 1), axis=1)[:, :n]
    lists = (unit @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, lists[nearest], axis=1).ravel())
    return int(needed[max(0, math.ceil(aim * len(needed)) - 1)]) + 1


@dataclass
class VectorIndex:
    """Rows by list, the centroids, the greatest angle of each list's rows to its centroid, and how many lists a query probes."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    probes: int

    @classmethod
    def write(cls, vectors: DataFrame, path: str, lists: int | None = None, aim: float = 0.93, sample: int = SAMPLE_ROWS, seed: int = 0) -> VectorIndex:
        """Store all rows of (chunk_id, embedding) by list, other columns with them.

        Centroids are fitted to about ``sample`` rows drawn by a hash of their ids; about the square root of the number of
        rows of them, unless ``lists`` says how many. Every row goes to the list of its nearest centroid, a large list to
        several files. One row for each list reaches the driver. The rows are shuffled once.
        """
        spark = vectors.sparkSession
        ship(spark)
        count = vectors.count()
        chosen = F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(count, 1)))
        drawn = vectors.where(chosen).select("embedding").toArrow().column("embedding").combine_chunks()
        widths = np.array([len(v) for v in drawn.to_pylist() if v], np.int64)
        width = int(np.bincount(widths).argmax()) if len(widths) else 0
        unit = _unit(_matrix(drawn, width)) if width else np.zeros((0, 0))
        unit = unit[~np.isnan(unit).any(axis=1)]
        lists = max(1, min(lists or round(math.sqrt(count)), MOST_LISTS, len(unit) // ROWS_A_LIST or 1))
        centres = centroids_of(unit, lists, seed) if len(unit) else np.zeros((1, max(width, 1)))
        probes = probes_for(unit, centres, aim) if len(unit) else 1
        share = np.bincount((unit @ centres.T).argmax(axis=1), minlength=len(centres)) / len(unit) if len(unit) else np.ones(1)
        files = np.maximum(1, np.ceil(share * count / ROWS_A_FILE)).astype(np.int32)
        place = vectors.columns.index("embedding")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _unit(_matrix(batch.column(place), centres.shape[1])) @ centres.T
                at, angle = near.argmax(axis=1).astype(np.int32), np.arccos(np.clip(near.max(axis=1), -1.0, 1.0))
                lost = np.isnan(near).any(axis=1)
                at[lost], angle[lost] = NOWHERE, 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(angle), pa.array(np.where(lost, 1, files[at]))], names=[*batch.schema.names, "__list", "__angle", "__files"])

        schema = T.StructType([*vectors.schema.fields, T.StructField("__list", T.IntegerType()), T.StructField("__angle", T.DoubleType()), T.StructField("__files", T.IntegerType())])
        placed = vectors.mapInArrow(assign, schema)
        dealt = placed.repartition("__list", F.pmod(F.xxhash64("chunk_id"), F.col("__files"))).drop("__files")
        dealt.write.mode("overwrite").partitionBy("__list").parquet(f"{path}/rows")
        about = spark.read.schema(T.StructType([*vectors.schema.fields, *schema.fields[-3:-1]])).parquet(f"{path}/rows").where(F.col("__list") >= 0).groupBy("__list").agg(F.max("__angle").alias("radius")).collect() if count else []
        radius = np.zeros(len(centres))
        for r in about:
            radius[r["__list"]] = r["radius"]
        shape = T.StructType([f for f in schema.fields if f.name != "__files"]).json()
        held = [(json.dumps({"centres": centres[i].tolist(), "radius": radius[i], "probes": probes, "schema": shape}), i) for i in range(len(centres))]
        spark.createDataFrame(held, "about string, list int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        """A stored index."""
        lists = [json.loads(r["about"]) for r in spark.read.parquet(f"{path}/lists").orderBy("list").collect()]
        rows = spark.read.schema(T.StructType.fromJson(json.loads(lists[0]["schema"]))).parquet(f"{path}/rows")
        return cls(rows, np.array([x["centres"] for x in lists]), np.array([x["radius"] for x in lists]), lists[0]["probes"])

    def lists_of(self, asked: np.ndarray, probes: int) -> list[np.ndarray]:
        """The lists of nearest centroids of each unit query; none for a query without a direction."""
        near = asked @ self.centres.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        return [np.zeros(0, np.int64) if np.isnan(asked[i]).any() else order[i] for i in range(len(asked))]

    def _scan(self, asked: np.ndarray, lists: list[np.ndarray], n: int, where) -> DataFrame:
        """(q, chunk_id, similarity): candidates of each query from its lists alone; only files of lists that are asked are read."""
        query = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        flat, query = flat[order], query[order]
        wanted = np.unique(flat)
        rows = self.rows if where is None else self.rows.where(where)
        rows = rows.where(F.col("__list").isin(wanted.tolist())).select("chunk_id", "embedding", "__list")
        kind, width = rows.schema["chunk_id"].dataType.simpleString(), self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy()
                unit = _unit(_matrix(batch.column(1), width))
                for one in np.unique(at):
                    mine = np.flatnonzero(at == one)
                    q = query[np.searchsorted(flat, one) : np.searchsorted(flat, one, side="right")]
                    near = np.round(asked[q] @ unit[mine].T, 9)
                    near[np.isnan(near)] = -np.inf
                    least = np.partition(near, -n, axis=1)[:, -n] if near.shape[1] > n else np.full(len(near), -np.inf)
                    i, r = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(q[i].astype(np.int32)), batch.column(0).take(pa.array(mine[r])), pa.array(near[i, r])], names=["q", "chunk_id", "similarity"])

        ship(self.rows.sparkSession)
        return rows.mapInArrow(run, f"q int, chunk_id {kind}, similarity double")

    def search(self, queries: DataFrame, n: int = 10, probes: int | None = None, exact: bool = False, where=None) -> DataFrame:
        """(query_id, chunk_id, similarity, distance, pos): the n nearest rows of each query (query_id, vector).

        Without ``exact`` each query sees the rows of its ``probes`` nearest lists. With it the lists that could still hold
        a row as near as the n-th found are read as well: a row of a list is at most the list's radius from its centroid,
        so its angle to the query is at least the centroid's less that radius; the result is that of the exhaustive
        search. ``where`` is a condition on the rows. Queries without a direction, or of another width, find nothing.
        Building the frame collects the queries, a block at a time, and for an exact search their first hits.
        """
        spark = self.rows.sparkSession
        keyed = queries.select("query_id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
        blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
        found = None
        for k in range(blocks):
            table = (keyed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else keyed).toArrow()
            ids, asked = table.column("query_id").to_pylist(), _unit(_matrix(table.column("vector").combine_chunks(), self.centres.shape[1]))
            lists = self.lists_of(asked, probes or self.probes)
            part = top(self._scan(asked, lists, n, where), n, F.desc("similarity"), F.asc("chunk_id"), by=("q",))
            if exact:
                part = self._completed(asked, lists, part, n, where)
            names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
            part = part.join(F.broadcast(names), "q").select("query_id", "chunk_id", "similarity", "pos")
            found = part if found is None else found.unionByName(part)
        return found.withColumn("distance", 1 - F.col("similarity"))

    def _completed(self, asked: np.ndarray, lists: list[np.ndarray], part: DataFrame, n: int, where) -> DataFrame:
        """First hits, and those of all further lists that their bound does not rule out."""
        spark = part.sparkSession
        first = part.select("q", "chunk_id", "similarity").toArrow()
        last = np.full(len(asked), -np.inf)
        q, near = first.column("q").to_numpy(), first.column("similarity").to_numpy()
        full = np.bincount(q, minlength=len(asked)) >= n
        least = np.full(len(asked), np.inf)
        np.minimum.at(least, q, near)
        last[full] = least[full]
        angle = np.arccos(np.clip(asked @ self.centres.T, -1.0, 1.0))
        bound = np.cos(np.maximum(0.0, angle - self.radius))
        more = []
        for i, seen in enumerate(lists):
            open_lists = bound[i] >= last[i] - 1e-8
            open_lists[seen] = False
            more.append(np.flatnonzero(open_lists) if len(seen) else seen)
        held = spark.createDataFrame(first, part.select("q", "chunk_id", "similarity").schema)
        if not any(len(x) for x in more):
            every = held
        else:
            every = held.unionByName(self._scan(asked, more, n, where))
        return top(every, n, F.desc("similarity"), F.asc("chunk_id"), by=("q",))
