"""N-gram Jaccard join: which documents have word shingles so alike that they belong together, exactly.

1. Postings. Every document's set of shingle hashes goes, packed in blocks, to buckets by hash. A bucket counts in how
   many sets a shingle stands and sends back those that stand in two or more.
2. Filter. Two sets are linked only if they share three quarters of either, so a set with fewer shared shingles has no
   links. What remains is ordered from the rarest shingle on; a linked pair has a shingle in common among the first
   n - ceil(0.75 n) + 1 of both (prefixes). Copies of one set go on as one.
3. Stars. Sets of a prefix shingle's list have its least set as leader. Each set is compared with the leader it meets
   most, and most groups are connected by that.
4. Tiles. Lists that still hold sets of different components become tiles; a tile is cut into bands of set size, of which
   only the same and the next can be linked, and bands into blocks of bounded size. In a pair of blocks the bits of
   hashed bitmaps that one set has and the other lacks bound the overlap from above; pairs over the bound have their
   sorted arrays intersected; pairs of one component are left out.
5. Components of all links.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, decided, filed, heavy_join, located, per_text, prepare, slices, trim
from .common import release as give_up
from .components import components

WORDS = 5
#: Similarity of linked sets: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Postings that a bucket holds on average, and that a task packs at a time.
BUCKET_POSTINGS = 1_500_000
PACK_POSTINGS = 1_500_000
#: A shingle in so many sets of one pack is not listed set by set, but sent once with its number.
HOT = 64
BITS = 2048
BLOCK_SETS = 512
MEMO_WORDS = 100_000
_C = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(32)


class _Words(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    h = ids[:n] + np.uint64(size)
    for k in range(1, size):
        h = (h ^ (h >> _S)) * _C + ids[k : k + n]
    h = (h ^ (h >> _S)) * _M
    return np.unique(h ^ (h >> _S))


def set_key(hashes: np.ndarray) -> bytes | None:
    """128-bit key of a set; None for the empty one."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def required(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of n must share with a linked one."""
    return (percent * n + 99) // 100


def linked(a: int, b: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


def frequency_codes(counts: np.ndarray) -> np.ndarray:
    """Numbers of sets as bytes that keep their order: exact below 64, above it in quarters of each doubling (to 2^53)."""
    fraction, power = np.frexp(counts.astype(np.float64))
    above = 64 + 4 * (power.astype(np.int64) - 7) + (8 * fraction - 4).astype(np.int64)
    return np.where(counts < 64, counts, np.minimum(above, 255)).astype(np.uint8)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set, as words of 64 bits."""
    bits = np.zeros(BITS, bool)
    bits[((hashes * _M) >> np.uint64(40)) % np.uint64(BITS)] = True
    return np.packbits(bits).view(np.uint64)


def set_table(docs: DataFrame, keep: list[str], size: int = WORDS) -> DataFrame:
    """Kept columns, n_shingles and the set's key (null: empty)."""

    def work(texts: list[bytes]) -> dict[str, list]:
        sets = [shingles(t, size) for t in texts]
        return {"n_shingles": [len(s) for s in sets], "__set": [set_key(s) for s in sets]}

    return per_text(docs, keep, lambda: work, [("n_shingles", pa.int64()), ("__set", pa.binary())], "n_shingles long, __set binary")


# Packed blocks ------------------------------------------------------------------------------------------------------


def _split(h: np.ndarray) -> bytes:
    """40-bit numbers as 32 and 8 bits."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint8).tobytes()


def _joined(blob: memoryview, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | (np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _pack(pack: int, sets: list[np.ndarray], keys: list[bytes], bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, kind, blob) of a pack: postings for the buckets, and the pack's own table."""
    sizes = np.array([len(s) for s in sets], np.uint32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    low = np.uint64((1 << bits) - 1)
    ids = ((flat & low) << np.uint64(40)) | (flat >> np.uint64(24))
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    counts = np.diff(np.append(starts, len(ids)))
    hot = np.repeat(counts >= HOT, counts)
    marks, mark_counts = ids[starts[counts >= HOT]], counts[counts >= HOT].astype(np.uint32)
    hot_ids, hot_owner = ids[hot], owner[hot]
    ids, owner = ids[~hot], owner[~hot]
    fingers = np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)
    buckets = np.arange((1 << bits) + 1, dtype=np.uint64)
    edges = np.append(np.searchsorted(ids, buckets[:-1] << np.uint64(40)), len(ids))
    mark_edges = np.append(np.searchsorted(marks, buckets[:-1] << np.uint64(40)), len(marks))
    lower = np.uint64((1 << 40) - 1)
    home = (fingers & low).astype(np.int64)
    by_home = np.argsort(home, kind="stable")
    home_edges = np.searchsorted(home[by_home], np.arange((1 << bits) + 1))
    for b in range(1 << bits):
        i, j = edges[b], edges[b + 1]
        k, m = mark_edges[b], mark_edges[b + 1]
        own = by_home[home_edges[b] : home_edges[b + 1]]
        if i == j and k == m and not len(own):
            continue
        yield b, 0, b"".join([
            struct.pack("<qIII", pack, j - i, m - k, len(own)),
            _split(ids[i:j] & lower), owner[i:j].tobytes(), _split(marks[k:m] & lower), mark_counts[k:m].tobytes(),
            own.astype(np.uint16).tobytes(), b"".join(keys[x] for x in own),
        ])
    yield pack & ((1 << bits) - 1), 1, struct.pack("<qII", pack, len(sets), len(hot_ids)) + sizes.tobytes() + hot_ids.tobytes() + hot_owner.tobytes() + b"".join(keys)


_BLOCK = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("blob", pa.large_binary())])
_BLOCK_DDL = "key long, kind int, blob binary"
_BUCKET_DDL = "key int, kind int, blob binary"


def _rows(rows: list[tuple[int, int, bytes]], key: pa.DataType | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key or pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "kind", "blob"])


def _postings(docs: DataFrame, bits: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        sets: list[np.ndarray] = []
        keys: list[bytes] = []
        seen: set[bytes] = set()
        held, number = 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            pack = int.from_bytes(xxhash.xxh3_64_digest(b"".join(keys) + struct.pack("<qq", part, number)), "little") >> 1
            out = _rows(list(_pack(pack, sets, keys, bits)), pa.int32())
            sets.clear()
            keys.clear()
            seen.clear()
            held, number = 0, number + 1
            return out

        for batch in batches:
            for _, texts in slices(batch, "text"):
                for text in texts:
                    s = shingles(text, size)
                    key = set_key(s)
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    sets.append(s)
                    keys.append(key)
                    held += len(s)
                    if held >= PACK_POSTINGS or len(sets) >= 65_000:
                        yield flush()
        if sets:
            yield flush()
        _WORDS.clear()
        trim()

    return docs.select("text").mapInArrow(run, _BUCKET_DDL)


def _count(table: pa.Table) -> pa.Table:
    """One bucket: for each pack, its postings whose shingle stands in two sets or more, its sets that an earlier pack has,
    and how frequent the shingles are that it sent once."""
    out: list[tuple[int, int, bytes]] = []
    packs, ids, owners, source, marks, mark_counts = [], [], [], [], [], []
    keys: list[tuple[bytes, int, int]] = []
    bucket = table.column("key")[0].as_py()
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
        view = memoryview(blob.as_buffer())
        if kind == 1:
            out.append((struct.unpack_from("<q", view)[0], 1, bytes(view)))
            continue
        pack, n, m, own = struct.unpack_from("<qIII", view)
        at = 20
        ids.append(_joined(view[at:], n))
        owners.append(np.frombuffer(view, np.uint16, n, at + 5 * n))
        at += 7 * n
        marks.append(_joined(view[at:], m))
        mark_counts.append(np.frombuffer(view[at + 5 * m : at + 9 * m], np.uint8).view(np.uint32))
        at += 9 * m
        local = np.frombuffer(view, np.uint8, 2 * own, at).view(np.uint16)
        at += 2 * own
        keys += [(bytes(view[at + 16 * i : at + 16 * i + 16]), pack, int(x)) for i, x in enumerate(local)]
        source.append(np.full(n, len(packs), np.uint32))
        packs.append(pack)
    if packs:
        flat, owner, src = np.concatenate(ids), np.concatenate(owners), np.concatenate(source)
        del ids, owners, source
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(flat)))
        mark, place = np.unique(np.concatenate(marks), return_inverse=True)
        totals, heads = np.bincount(place, np.concatenate(mark_counts), len(mark)).astype(np.int64), flat[starts]
        if len(mark) and len(heads):
            spot = np.minimum(np.searchsorted(heads, mark), len(heads) - 1)
            fits = heads[spot] == mark
            spot = spot[fits]
            totals[fits] += counts[spot]
            everywhere = counts.copy()
            everywhere[spot] = totals[fits]
        else:
            everywhere = counts
        mark_codes = np.split(frequency_codes(totals)[place], np.cumsum([len(m) for m in marks])[:-1])
        df = np.repeat(frequency_codes(everywhere), counts)
        some = df >= 2
        flat, df, order = flat[some], df[some], order[some]
        owner, src = owner[order], src[order]
        by = np.argsort(src, kind="stable")
        edges = np.searchsorted(src[by], np.arange(len(packs) + 1))
        # Of equal sets the one of the least pack goes on.
        keys.sort()
        later: dict[int, list[int]] = {}
        for (key, _, _), (after, pack, x) in zip(keys, keys[1:], strict=False):
            if key == after:
                later.setdefault(pack, []).append(x)
        for p, pack in enumerate(packs):
            own = by[edges[p] : edges[p + 1]]
            dup = later.get(pack, [])
            if len(own) or dup or len(mark_codes[p]):
                out.append((pack, 2, struct.pack("<qIII", bucket, len(own), len(dup), len(mark_codes[p])) + _split(flat[own]) + df[own].tobytes() + owner[own].tobytes() + np.array(dup, np.uint16).tobytes() + mark_codes[p].tobytes()))
        del flat, owner, src, order, df, by, keys
    trim()
    return pa.Table.from_batches([_rows(out)])


_SETS_DDL = "node binary, size int, shared binary, bits binary, prefix array<long>"


def _survivors(percent: int):
    """One pack: its sets that may have links, with their shared shingles, bitmap and prefix."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"node": [], "size": [], "shared": [], "bits": [], "prefix": []}
        ids, dfs, owners, dups = [], [], [], []
        sizes, keys = np.zeros(0, np.uint32), b""
        hot_ids, hot_owner, hot_codes = np.zeros(0, np.uint64), np.zeros(0, np.uint16), {}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            view = memoryview(blob.as_buffer())
            if kind == 1:
                _, n, m = struct.unpack_from("<qII", view)
                at = 16
                sizes = np.frombuffer(view, np.uint8, 4 * n, at).view(np.uint32)
                at += 4 * n
                hot_ids = np.frombuffer(bytes(view[at : at + 8 * m]), np.uint64)
                hot_owner = np.frombuffer(bytes(view[at + 8 * m : at + 10 * m]), np.uint16)
                keys = bytes(view[at + 10 * m :])
            else:
                bucket, n, d, m = struct.unpack_from("<qIII", view)
                at = 20
                ids.append(_joined(view[at:], n) | (np.uint64(bucket) << np.uint64(40)))
                dfs.append(np.frombuffer(view, np.uint8, n, at + 5 * n))
                owners.append(np.frombuffer(bytes(view[at + 6 * n : at + 8 * n]), np.uint16))
                dups.append(np.frombuffer(bytes(view[at + 8 * n : at + 8 * n + 2 * d]), np.uint16))
                hot_codes[bucket] = np.frombuffer(view, np.uint8, m, at + 8 * n + 2 * d)
        if len(hot_ids):
            # Codes come back in the order of the sorted distinct shingles, as buckets are their leading bits.
            codes = np.concatenate([hot_codes[b] for b in sorted(hot_codes)])
            ids.append(hot_ids)
            dfs.append(codes[np.unique(hot_ids, return_inverse=True)[1]])
            owners.append(hot_owner)
        if ids and len(sizes):
            flat, df, owner = np.concatenate(ids), np.concatenate(dfs), np.concatenate(owners)
            shared = np.bincount(owner, minlength=len(sizes))
            alive = shared >= required(sizes.astype(np.int64), percent)
            if dups:
                alive[np.concatenate(dups)] = False
            some = alive[owner]
            flat, df, owner = flat[some], df[some], owner[some]
            order = np.lexsort((flat, df, owner))
            flat, owner = flat[order], owner[order]
            edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
            for x in np.flatnonzero(alive):
                own, n = flat[edges[x] : edges[x + 1]], int(sizes[x])
                # Shingles of this set alone come first in its order; they meet nothing.
                first = n - int(required(n, percent)) + 1 - (n - len(own))
                whole = np.sort(own)
                out["node"].append(keys[16 * x : 16 * x + 16])
                out["size"].append(n)
                out["shared"].append(whole.tobytes())
                out["bits"].append(bitmap(whole).tobytes())
                out["prefix"].append(own[: max(first, 0)].astype(np.int64))
        trim()
        types = {"node": pa.binary(), "size": pa.int32(), "shared": pa.binary(), "bits": pa.binary(), "prefix": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    return run


# Comparing ----------------------------------------------------------------------------------------------------------


def overlap_bound(a: np.ndarray, b: np.ndarray, shared_a: np.ndarray, shared_b: int) -> np.ndarray:
    """Upper bounds of the overlaps of sets (rows of bitmaps a) with one set (bitmap b): each bit that only one has is an element that the other lacks."""
    only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(~a & b).sum(axis=1, dtype=np.int64)
    return np.minimum(shared_a - only_a, shared_b - only_b)


def compare(one: dict, rows: dict, index: np.ndarray, percent: int) -> np.ndarray:
    """Which of the rows at ``index`` are linked with a set: size, bitmap bound, then the sorted arrays."""
    n, m = one["size"], rows["size"][index]
    small, large = np.minimum(n, m), np.maximum(n, m)
    index = index[100 * small >= percent * large]
    if not len(index):
        return index
    m = rows["size"][index]
    bound = overlap_bound(rows["bits"][index], one["bits"], rows["count"][index], len(one["shared"]))
    index = index[(100 + percent) * bound >= percent * (n + m)]
    found = [i for i in index if linked(n, int(rows["size"][i]), len(np.intersect1d(one["shared"], rows["shared"][i], assume_unique=True)), percent)]
    return np.array(found, np.int64)


def _loaded(table: pa.Table) -> dict:
    shared = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shared")]
    bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bits")]
    return {"node": table.column("node").to_pylist(), "size": np.array(table.column("size").to_pylist(), np.int64), "shared": shared, "count": np.array([len(s) for s in shared], np.int64), "bits": np.array(bits).reshape(len(shared), -1)}


def _one(rows: dict, i: int) -> dict:
    return {"size": int(rows["size"][i]), "shared": rows["shared"][i], "bits": rows["bits"][i]}


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _edges(found: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})


def _star(percent: int):
    """One part of a star: which members are linked with the leader."""

    def run(table: pa.Table) -> pa.Table:
        leads = np.array(table.column("leads").to_pylist(), bool)
        rows = _loaded(table)
        at = np.flatnonzero(leads)
        if not len(at):
            return _edges([])
        got = compare(_one(rows, at[0]), rows, np.flatnonzero(~leads), percent)
        return _edges([(rows["node"][i], rows["node"][at[0]]) for i in got])

    return run


def _tile(percent: int):
    """One pair of blocks: links between sets of different components."""

    def run(table: pa.Table) -> pa.Table:
        rows = _loaded(table)
        group = {x: i for i, x in enumerate(sorted(set(table.column("root").to_pylist())))}
        root = np.array([group[x] for x in table.column("root").to_pylist()])
        side = np.array(table.column("side").to_pylist())
        found = []
        order = np.argsort(rows["size"], kind="stable")
        left = order[side[order] != 2]  # sides: 0 the first block, 2 the second, 1 a block with itself
        for i in left:
            other = np.flatnonzero((side == 2) if side[i] == 0 else (np.arange(len(side)) != i))
            other = other[root[other] != root[i]]
            for j in compare(_one(rows, i), rows, other, percent):
                if root[i] != root[j]:
                    found.append((rows["node"][i], rows["node"][j]))
                    root[root == root[j]] = root[i]
        return _edges(found)

    return run


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of frames that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def similar_sets(docs: DataFrame, total: int, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """(node, root) of all sets that are linked with another one; ``total`` is the number of shingles of all sets."""
    spark = docs.sparkSession
    prepare(spark)
    bits = max(3, int(np.ceil(np.log2(max(1, total / BUCKET_POSTINGS)))))
    parts = 1 << bits
    posted = _postings(docs, bits, size).repartitionById(parts, "key")  # a task for each bucket
    counted = posted.groupBy("key").applyInArrow(_count, _BLOCK_DDL)
    packs = max(8, int(np.ceil(total / PACK_POSTINGS)))
    sets = cut(counted.repartition(packs, "key").groupBy("key").applyInArrow(_survivors(percent), _SETS_DDL))
    del posted, counted
    release(spark)

    prefix = cut(sets.select("node", F.explode("prefix").alias("h")))
    # Keys that many sets share (shingles, leaders, bands of tiles) are joined by their small rows, heavy ones dealt out.
    heads = prefix.groupBy("h").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = heavy_join(prefix, heads, ["h"], "n", total=prefix.count()).where(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c"))
    chosen = cut(met.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader")))
    stars = cut(chosen.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_SETS).cast("int")))
    # A leader goes to all parts of its star, a member to one, from its own place and not by way of the leader's.
    seats = heavy_join(chosen, stars, ["leader"], "n").select("node", F.col("leader").alias("tile"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    member = sets.drop("prefix").join(seats, "node").select("tile", "part", F.lit(False).alias("leads"), "node", "size", "shared", "bits")
    stars = stars.withColumnRenamed("leader", "node")
    leader = sets.drop("prefix").join(stars, "node").select(F.col("node").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"), "node", "size", "shared", "bits")
    first = cut(member.unionByName(leader).groupBy("tile", "part").applyInArrow(_star(percent), "a binary, b binary"))
    roots = components(first)

    placed = prefix.join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    open_lists = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("tile"), F.count(F.lit(1)).alias("n"))
    open_lists = cut(open_lists.where(F.col("low") != F.col("high")).select("h", "tile", "n"))
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    inside = cut(heavy_join(placed, open_lists, ["h"], "n").select("tile", "node", "root").distinct())
    banded = inside.join(sets.select("node", "size"), "node").withColumn("band", band)
    # One row for each band of a tile: its blocks, and those of the bands next to it.
    held = banded.groupBy("tile", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_SETS).cast("int"))
    near = held.withColumn("at", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).groupBy("tile", F.col("at").alias("band"))
    mine = F.col("at") == F.col("band")
    near = near.agg(F.max(F.when(mine, F.col("n"))).alias("n"), F.max(F.when(mine, F.col("blocks"))).alias("blocks"), F.collect_list(F.struct("band", "blocks")).alias("others"))
    own = heavy_join(banded, cut(near.where("n is not null")), ["tile", "band"], "n")
    own = own.select("tile", "band", "node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.explode("others").alias("next"))
    wide = own.withColumn("other", F.col("next.band")).withColumn("against", F.explode(F.sequence(F.lit(0), F.col("next.blocks") - 1)))
    me, it = F.struct(F.col("band").alias("band"), F.col("block").alias("block")), F.struct(F.col("other").alias("band"), F.col("against").alias("block"))
    pairs = wide.select("tile", F.least(me, it).alias("p"), F.greatest(me, it).alias("q"), F.when(me == it, 1).when(me < it, 0).otherwise(2).alias("side"), "node", "root")
    tiles = pairs.join(sets.drop("prefix"), "node")
    second = cut(tiles.groupBy("tile", "p", "q").applyInArrow(_tile(percent), "a binary, b binary"))
    return components(first.unionByName(second))


def jaccard_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """Group rows whose ``text`` sets of word shingles are linked, directly or through others.

    Returns ``keep``, n_shingles, component_id (least doc_id of the component, nulls left out) and __set, the set's key.
    Two sets are linked when 100 * intersection >= percent * union. A null text, or one without words, has no shingles
    and is alone: its component_id is its own doc_id. With fewer words than a shingle the whole sequence is the one
    shingle. Copies and repeated rows are one set and are never compared with each other. Ties do not arise: equal ids
    give one component id. An empty table gives an empty result; columns other than ``keep`` and the text are ignored.
    ``keep`` must hold doc_id. Texts are not shuffled and not held; see the module for what is.
    """
    spark = docs.sparkSession
    rows = cut(set_table(docs, list(keep), size))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return rows.select(*keep, "n_shingles", F.col("doc_id").alias("component_id"), "__set")
    firsts = rows.where(F.col("__set").isNotNull()).groupBy("__set").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("__copies"))
    roots = similar_sets(docs, total, percent, size)
    release(spark)
    joined = cut(firsts.join(roots.select(F.col("node").alias("__set"), "root"), "__set", "left"))
    groups = joined.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    # Few groups may hold most sets, and few sets most rows.
    grouped = heavy_join(joined.where(F.col("root").isNotNull()), groups, ["root"], "sets").select("__set", "component_id", "__copies")
    named = cut(grouped.unionByName(joined.where(F.col("root").isNull()).select("__set", F.col("least").alias("component_id"), "__copies")))
    having = heavy_join(rows.where(F.col("__set").isNotNull()), named, ["__set"], "__copies")
    lacking = rows.where(F.col("__set").isNull()).withColumn("component_id", F.col("doc_id"))
    return having.select(*keep, "n_shingles", "component_id", "__set").unionByName(lacking.select(*keep, "n_shingles", "component_id", "__set"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """One row of each group of linked rows, with all columns: the one of the least doc_id, then the first by file and place.

    Rows without words, null texts among them, all stay. Rows whose ids are null are groups of copies only. Ties and
    repeated rows leave one row. An empty table stays empty; other columns, whatever their names, are carried along.
    Decisions go back to the rows as bitmaps; no text is shuffled. Building the frame runs jobs.
    """
    rows = filed(docs)
    groups = jaccard_groups(located(rows, "doc_id", "text"), ("doc_id", "__file", "__at"), percent, size)
    alone = groups.where(F.col("__set").isNull()).select("__file", "__at")
    first = groups.where(F.col("__set").isNotNull() & (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))))
    first = first.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("__set")).alias("__own")).agg(F.min(F.struct("__file", "__at")).alias("one")).select("one.*")
    stays = cut(alone.unionByName(first).withColumn("n", F.lit(1)))
    return decided(rows, stays, 1).where("__n = 1").select("__all.*")
