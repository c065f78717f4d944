"""Importance resampling towards a target distribution, on hashed word n-grams held in partition-local tries.

A feature is a run of one or two consecutive words; its bucket is the CRC-32 of its bytes modulo the number of buckets.
A worker keeps the runs of its partition in a trie of words. A node holds its run's count and its CRC state, so a child's
state follows from its parent's: reading len more bytes is a linear map of the 32 bits, the same for every state. When the
trie is full, or the partition ends, counts go to their buckets and the trie starts anew; bucket totals are summed by
Spark. The same trie, with each node's gain attached in place of a count, then scores every document by its paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, prepare, running, slices, trim

BUCKETS = 10_000
#: Nodes of a trie, after which it is emptied: 20 bytes a run of two words, 40 a word.
NODES = 1 << 18
#: Rows that are ranked in one task.
RANKED_ROWS = 20_000
#: Longer words are read by zlib, and the tables of their lengths are not kept.
TABLE_BYTES = 64

#: A-Z lower-cased; digits, letters and all beyond ASCII make words, the rest stands between them.
_CASE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    """The state that each byte leads to from zero: eight shifts by the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_BYTE = _byte_table()


def word_states(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32, bytes) of all words of some texts in order, and the number of words of each text."""
    joined = np.frombuffer(b" " + b"".join(t.translate(_CASE) + b" " for t in texts), np.uint8)
    inside = joined != 32
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    sizes = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(sizes <= TABLE_BYTES)
    for k in range(TABLE_BYTES):
        if not len(left):
            break
        now = state[left]
        state[left] = _BYTE[(now ^ joined[starts[left] + k]) & 255] ^ (now >> 8)
        left = left[sizes[left] > k + 1]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > TABLE_BYTES):
        state[i] = zlib.crc32(joined[starts[i] : ends[i]])
    bounds = np.cumsum([1 + len(t) for t in texts])
    return state, sizes, np.diff(np.searchsorted(starts, bounds), prepend=0)


class _Steps:
    """For each length, four tables of 256 states by which any CRC state advances over so many bytes of zero."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def __call__(self, states: np.ndarray, length: int) -> np.ndarray:
        table = self.tables.get(length)
        if table is None:
            zeros = bytes(length)
            plain = zlib.crc32(zeros)
            bits = np.array([zlib.crc32(zeros, 1 << k) ^ plain for k in range(32)], np.uint32).reshape(4, 8)
            chosen = (np.arange(256)[:, None] >> np.arange(8)) & 1
            table = np.bitwise_xor.reduce(np.where(chosen[None], bits[:, None, :], np.uint32(0)), axis=2).astype(np.uint32)
            if length <= TABLE_BYTES:
                self.tables[length] = table
        return table[0][states & 255] ^ table[1][(states >> 8) & 255] ^ table[2][(states >> 16) & 255] ^ table[3][states >> 24]

    def read(self, states: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """States after more bytes, of which the numbers and the states by themselves are given."""
        out = np.zeros(len(states), np.uint32)
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            out[some] = self(states[some], int(size)) ^ own[some]
        return out


class WordTrie:
    """Runs of one and two words. Nodes below the root are known by state and length of their word (words alike in both lead
    to the same buckets throughout) and numbered as they come; their children are a sorted array of both numbers."""

    def __init__(self, buckets: int = BUCKETS, gains: np.ndarray | None = None, limit: int = NODES):
        self.buckets, self.gains, self.limit = buckets, gains, limit
        self.totals = np.zeros(buckets, np.int64)
        self.step = _Steps()
        self.clear()

    def clear(self) -> None:
        self.words, self.order = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted words, and their numbers
        self.state = self.spaced = np.zeros(0, np.uint32)
        self.size = self.value = np.zeros(0, np.int64)
        self.keys, self.child_state, self.child_value = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _values(self, states: np.ndarray) -> np.ndarray:
        """What a new node holds besides its state: a count of none yet, or its gain."""
        return np.zeros(len(states), np.int64) if self.gains is None else self.gains[states % self.buckets]

    @staticmethod
    def _places(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted distinct keys stand or belong in a sorted array, and which of them are there."""
        at = np.searchsorted(held, keys)
        there = np.zeros(len(keys), bool)
        inside = at < len(held)
        there[inside] = held[at[inside]] == keys[inside]
        return at, there

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of some texts, and how many words each text has; new words become nodes below the root."""
        state, size, sizes = word_states(texts)
        words, back = np.unique((size << 32) | state.astype(np.int64), return_inverse=True)
        at, there = self._places(self.words, words)
        fresh = words[~there]
        numbers = np.zeros(len(words), np.int64)
        numbers[there] = self.order[at[there]]
        numbers[~there] = len(self.state) + np.arange(len(fresh))
        if len(fresh):
            self.order, self.words = np.insert(self.order, at[~there], numbers[~there]), np.insert(self.words, at[~there], fresh)
            state, size = (fresh & 0xFFFFFFFF).astype(np.uint32), fresh >> 32
            spaced = self.step.read(np.full(len(fresh), zlib.crc32(b" "), np.uint32), size, state)
            self.state, self.spaced = np.concatenate([self.state, state]), np.concatenate([self.spaced, spaced])
            self.size, self.value = np.concatenate([self.size, size + 1]), np.concatenate([self.value, self._values(state)])
        return numbers[back], sizes

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted distinct keys (parent and word) among the children; missing ones are added."""
        at, there = self._places(self.keys, keys)
        fresh = keys[~there]
        if len(fresh):
            last = fresh & 0xFFFFFFFF
            state = self.step.read(self.state[fresh >> 32], self.size[last], self.spaced[last])
            self.child_state = np.insert(self.child_state, at[~there], state)
            self.child_value = np.insert(self.child_value, at[~there], self._values(state))
            self.keys = np.insert(self.keys, at[~there], fresh)
        return at + np.cumsum(~there) - ~there

    @staticmethod
    def _pairs(numbers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of neighbouring words of the same text, and the text of each."""
        same = text[1:] == text[:-1]
        return ((numbers[:-1] << 32) | numbers[1:])[same], text[1:][same]

    def _full(self) -> bool:
        return len(self.keys) + len(self.state) > self.limit

    def count(self, texts: list[bytes]) -> None:
        """Add the runs of some texts."""
        numbers, sizes = self._numbers(texts)
        self.value += np.bincount(numbers, minlength=len(self.state))
        keys, times = np.unique(self._pairs(numbers, np.repeat(np.arange(len(sizes)), sizes))[0], return_counts=True)
        places = self._children(keys)
        self.child_value[places] += times
        if self._full():
            self.flush()

    def flush(self) -> None:
        """Move the counts to their buckets and empty the trie."""
        for states, values in ((self.state, self.value), (self.child_state, self.child_value)):
            self.totals += np.bincount(states % self.buckets, weights=values, minlength=self.buckets).astype(np.int64)
        self.clear()

    def weigh(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, features, sum of gains along the paths) of each text."""
        numbers, sizes = self._numbers(texts)
        text = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(text, weights=self.value[numbers], minlength=len(sizes))
        pairs, owner = self._pairs(numbers, text)
        keys, back = np.unique(pairs, return_inverse=True)
        places = self._children(keys)
        total += np.bincount(owner, weights=self.child_value[places][back], minlength=len(sizes))
        if self._full():
            self.clear()
        return sizes, np.maximum(2 * sizes - 1, 0), total.astype(np.int64)


def bucket_totals(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, limit: int = NODES) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any are left out.

    Null and empty texts have no features; a row that is repeated counts again; an empty table gives an empty result. A
    task sends a row for each bucket at most.
    """
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(buckets, limit=limit)
        for batch in batches:
            for _, some in slices(batch, column):
                trie.count(some)
        trie.flush()
        held = np.flatnonzero(trie.totals)
        out = pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(trie.totals[held])], names=["bucket", "n"])
        del trie
        trim()
        yield out

    return texts.select(column).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: how much likelier it is in the target than in the raw texts, each bucket counted once more.

    Takes (bucket, n) of both; one row for each bucket, at most ``buckets``, reaches the driver.
    """
    spark = raw.sparkSession
    n = lambda d, name: d.select("bucket", F.col("n").alias(name))
    both = cut(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(n(raw, "s"), "bucket", "left").join(n(target, "t"), "bucket", "left").fillna(0, ["s", "t"]))
    whole = both.agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).first()
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(whole["s"] + buckets) / ((F.col("s") + F.lit(1.0)) * F.lit(whole["t"] + buckets))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def noise(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, floored, from the SHA-256 of the seed and a row's key; a null key is an empty one."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((head + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", least_words: int = 20, percent: int = 25, seed: int = 7, buckets: int = BUCKETS, limit: int = NODES, ranked_rows: int = RANKED_ROWS
) -> DataFrame:
    """(key, n_features, weight, score, rank) of each row of ``docs``: how far its ``text`` leans to the texts of ``target``.

    ``weight`` is the floored mean gain of a text's features, ``score`` adds a Gumbel draw from the key, so taking the best
    scores samples without replacement by weight. Of the rows of ``least_words`` words or more the best ``percent`` of a
    hundred get a rank from 1; ties go to the smaller key, a null key last; the others' rank is null. A null or empty text
    has no features and weight 0; rows repeated with their keys are drawn one by one; an empty table gives an empty
    result, an empty target weighs against what is common; other columns are ignored, whatever their names. Texts stay
    where they are: bucket totals and one small row for each text are all that is moved. Building the frame runs jobs.
    """
    gains = bucket_gains(bucket_totals(docs, buckets=buckets, limit=limit), bucket_totals(target, buckets=buckets, limit=limit), buckets)

    def make():
        trie = WordTrie(buckets, gains, limit)

        def work(texts: list[bytes]) -> dict[str, list]:
            words, features, total = trie.weigh(texts)
            return {"__words": words, "n_features": features, "weight": np.floor_divide(total, np.maximum(features, 1))}

        return work

    fields = [("__words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]
    scored = per_text(docs, [key], make, fields, "__words long, n_features long, weight long")
    scored = cut(scored.withColumns({"score": F.col("weight") + noise(F.col(key), seed), "__row": F.monotonically_increasing_id()}))
    able = scored.where(F.col("__words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.col(key).asc_nulls_last(), F.asc("__row")]
    ranked = running(able, order, {"rank": F.lit(1.0)}, ranked_rows)
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))
    columns = [F.col(f"`{key}`"), F.col("n_features"), F.col("weight"), F.col("score")]
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(F.col("__words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
