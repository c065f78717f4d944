"""Hard negatives by bit-sliced integer products.

A component is a whole number; its bits are planes. The product of an anchor with a row is a sum over the row's planes,
the most significant first. After each plane the rest is known to lie between two bounds, so a score lies in an interval
that halves with every plane; pairs whose interval cannot reach what is still sought are dropped, first by tiles of rows
and anchors, then pair by pair. Scores of the pairs that stay to the last plane are exact.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, shared_folder, trim

#: Anchors that one pass over the rows takes, and that a worker multiplies at a time; rows of a tile, and of the first one.
BLOCK_ANCHORS, STEP_ANCHORS, TILE_ROWS, FIRST_ROWS = 16_384, 2_048, 1_024, 64
#: Share of a tile's pairs below which they are followed one by one, and pairs that are followed at a time.
FEW_PAIRS, STEP_PAIRS = 0.05, 200_000
#: Components are held to this bound (of numbers this large not even sums of a few thousand would fit 64 bits).
MOST_COMPONENT = 1 << 26


def whole_components(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, taken as doubles."""
    bound = F.lit(float(MOST_COMPONENT))
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(scale), -bound), bound)).cast("int"))


def usable(vector: Column, label: Column) -> Column:
    """Whether a row takes part: a label, a vector, and no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(fine, F.lit(False))


class Anchors:
    """Anchors as a matrix of whole numbers with the bounds of what a plane can add."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.up, self.down = np.clip(matrix, 0, None).sum(axis=1), np.clip(matrix, None, 0).sum(axis=1)

    def __getitem__(self, some) -> Anchors:
        return Anchors(self.matrix[some])


def products(rows: np.ndarray, anchors: Anchors, low: np.ndarray, high: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs whose product lies between the anchor's low and high; of ``allowed`` pairs only.

    Planes are of the rows' components above their least one. Sums are exact: 32-bit floats where all stay below 2**24,
    doubles below 2**53, else whole numbers of 64 bits.
    """
    least = int(rows.min(initial=0))
    lifted = rows - least
    planes = int(lifted.max(initial=0)).bit_length()
    most = int(np.abs(anchors.matrix).max(initial=0)) * rows.shape[1] * (abs(least) + (1 << planes))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    by = anchors.matrix.T.astype(kind)
    up, down, low, high = (np.asarray(x).astype(kind if kind is not np.int64 else np.float64) for x in (anchors.up, anchors.down, low, high))
    partial = np.repeat((least * anchors.matrix.sum(axis=1)).astype(kind)[None, :], len(rows), axis=0)
    alive = np.ones(partial.shape, bool) if allowed is None else allowed
    r = a = score = None
    for p in range(planes - 1, -1, -1):
        rest = (1 << p) - 1
        if r is None:
            partial += (((lifted >> p) & 1).astype(kind) @ by) * kind(1 << p)
            alive = alive & (partial >= low - up * rest) & (partial <= high - down * rest)
            if np.count_nonzero(alive) < FEW_PAIRS * alive.size:
                r, a = np.nonzero(alive)
                score = partial[r, a]
            continue
        bits = ((lifted >> p) & 1).astype(kind)
        for k in range(0, len(r), STEP_PAIRS):
            s = slice(k, k + STEP_PAIRS)
            score[s] += np.einsum("nd,nd->n", bits[r[s]], by.T[a[s]]) * kind(1 << p)
        kept = (score >= low[a] - up[a] * rest) & (score <= high[a] - down[a] * rest)
        r, a, score = r[kept], a[kept], score[kept]
    if r is None:
        r, a = np.nonzero(alive & (partial >= low) & (partial <= high))
        score = partial[r, a]
    return r, a, score.astype(np.int64)


class Best:
    """The k best (score, id) of many groups, the highest score first, ties to the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score, self.id, self.held = np.zeros((groups, k), np.int64), np.zeros((groups, k), np.int64), np.zeros(groups, np.int64)

    def least(self, floor: np.ndarray) -> np.ndarray:
        """The score that a row must reach in each group: its k-th best, or the floor while it has fewer."""
        return np.where(self.held == self.k, np.maximum(self.score[:, -1], floor), floor)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        some = np.unique(group)
        old_group, old_at = np.nonzero(np.arange(self.k)[None, :] < self.held[some][:, None])
        group = np.concatenate([some[old_group], group])
        score = np.concatenate([self.score[some[old_group], old_at], score])
        ids = np.concatenate([self.id[some[old_group], old_at], ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.searchsorted(group, some)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        kept = rank < self.k
        self.score[group[kept], rank[kept]], self.id[group[kept], rank[kept]] = score[kept], ids[kept]
        self.held[some] = np.minimum(np.diff(np.append(first, len(group))), self.k)

    def batch(self) -> pa.RecordBatch:
        g, at = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(self.id[g, at]), pa.array(self.score[g, at])], names=["g", "id", "score"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as a matrix: shorter ones end in zeros, what is beyond the width meets nothing."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    line = np.arange(width)[None, :]
    inside = line < lengths[:, None]
    out[inside] = flat[((np.cumsum(lengths) - lengths)[:, None] + line)[inside]]
    return out


def _tiles(batches: Iterator[pa.RecordBatch], width: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, numbers of labels, components) of a few rows at a time; labels that no anchor has are -1."""
    size = FIRST_ROWS
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            labels = part.column(1).to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(known, labels), len(known) - 1)
            yield part.column(0).to_numpy(zero_copy_only=False), np.where(known[place] == labels, place, -1), _matrix(part.column(2), width)
            at, size = at + size, TILE_ROWS


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each group of all tasks."""
    window = Window.partitionBy("g").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _block(rows: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Hard negatives of the anchors of one block, against all rows."""
    spark = rows.sparkSession
    ids = anchors.column("id").to_numpy()
    labels = anchors.column("label").to_numpy()
    known, numbers = np.unique(labels, return_inverse=True)
    width = max(pc.max(pc.list_value_length(anchors.column("v"))).as_py() or 0, 1)
    matrix = _matrix(anchors.column("v").combine_chunks(), width)
    schema = "g int, id long, score long"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = Best(len(ids), positives), np.full(len(ids), -np.inf)
        of_label = [np.flatnonzero(numbers == k) for k in range(len(known))]
        for row_ids, row_labels, values in _tiles(batches, width, known):
            for k in np.unique(row_labels[row_labels >= 0]):
                mine = np.flatnonzero(row_labels == k)
                for at in range(0, len(of_label[k]), STEP_ANCHORS):
                    some = of_label[k][at : at + STEP_ANCHORS]
                    other = row_ids[mine][:, None] != ids[some][None, :]
                    r, a, score = products(values[mine], Anchors(matrix[some]), best.least(floor)[some], np.full(len(some), np.inf), other)
                    best.add(some[a], score, row_ids[mine][r])
        yield best.batch()
        del best
        trim()

    near = _first(rows.mapInArrow(nearest, schema), positives).select("g", "id", "score", "rank").toArrow()
    scores, names = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
    have = np.zeros((len(ids), positives), bool)
    g, slot = near.column("g").to_numpy(), near.column("rank").to_numpy() - 1
    scores[g, slot], names[g, slot], have[g, slot] = near.column("score").to_numpy(), near.column("id").to_numpy(), True
    # Whole numbers n with low * p <= 100 * n <= high * p; there are none where p is negative and low < high.
    least, most = -((-low * scores) // 100), (high * scores) // 100
    have &= least <= most
    some = np.flatnonzero(have.any(axis=1))

    def hardest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(some) * positives, negatives)
        floor, top = np.where(have, least, np.iinfo(np.int64).max)[some], np.where(have, most, np.iinfo(np.int64).min)[some]
        highest = top.max(axis=1, initial=np.iinfo(np.int64).min).astype(float)
        tiles = _tiles(batches, width, known) if len(some) else iter(())
        for row_ids, row_labels, values in tiles:
            for at in range(0, len(some), STEP_ANCHORS):
                part = np.arange(at, min(at + STEP_ANCHORS, len(some)))
                sought = best.least(floor.ravel()).reshape(floor.shape)[part]
                r, a, score = products(values, Anchors(matrix[some[part]]), sought.min(axis=1), highest[part], row_labels[:, None] != numbers[some[part]][None, :])
                for k in range(positives):
                    fit = (score >= sought[a, k]) & (score <= top[part][a, k])
                    best.add(part[a[fit]] * positives + k, score[fit], row_ids[r[fit]])
        yield best.batch()
        del best
        trim()

    found = _first(rows.mapInArrow(hardest, schema), negatives)
    pairs = [(int(i * positives + k), int(ids[x]), int(names[x, k]), int(scores[x, k])) for i, x in enumerate(some) for k in range(positives) if have[x, k]]
    asked = spark.createDataFrame(pa.table({n: pa.array([p[i] for p in pairs], t) for i, (n, t) in enumerate((("g", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())))}))
    return found.join(F.broadcast(asked), "g").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, block: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over (vec_id, embedding, label).

    Scores are products of floor(scale * x). Positives are an anchor's best rows of its own label; the negatives of each
    are the best rows of other labels with low % to high % of its score. Ties go to the smaller vec_id. Rows with a null
    id or label, a null vector, or a null or non-finite component take no part; missing components count as 0, and
    components beyond 2**26 are held there. Rows that share an anchor's id are never its positives (as negatives they may
    count, with another label); repeated anchors are answered row by row, repeated rows compete row by row. An empty table,
    or no anchor, gives an empty result; other columns are ignored. Anchors are the stated queries: a block of at most
    ``block`` of them goes to all rows at a time, which stay where they are, and a task returns its best for each. Several
    blocks are written to the shared folder one after the other. Building the frame runs jobs.
    """
    spark = vectors.sparkSession
    prepare(spark)
    names = ("vec_id", "embedding", "label")
    rows = vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).select(*names, "__anchor").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), F.col("label")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), "label", whole_components(F.col("embedding"), scale).alias("v"), "__anchor")
    asked, rows = rows.where("__anchor").drop("__anchor"), rows.drop("__anchor")
    blocks = math.ceil(1.25 * asked.count() / block) if asked.limit(block + 1).count() > block else 1
    if blocks == 1:
        table = asked.toArrow()
        if not table.num_rows:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return _block(rows, table, positives, negatives, low, high)
    path = f"{shared_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    for k in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        if table.num_rows:
            _block(rows, table, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.parquet(path)
