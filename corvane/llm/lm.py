"""Language-model scoring of order three with sharded Elias-Fano tries.

Texts are tokenised once, in packs of about a million tokens. A pack sends to each shard, which is a range of word hashes,
its distinct words and the distinct pairs (context, word) whose context lies there, and below each pair the words that
follow it, all with their training counts. A shard adds the counts of all packs and builds its part of the trie: level one
has the contexts, level two their successors, level three the successors of pairs, each level an Elias-Fano sequence with
monotone pointers into the next one, one byte for each node, its quantised smoothed probability, and one for each pair, its
quantised back-off weight, with finer codes for frequent ones. The levels lie packed in a memory-mapped file for as long as the shard answers: for each pair it
finds the context, then the successor inside the context's range, then the pair's successors inside the pair's range. The
answers go back to the packs, which combine them by document. So a frequent word, pair or triple is sent once for each pack
and answered once, no part of the model is larger than its shard, and the model as a whole is on no machine.

The model, with counts c over training tokens, discount D and N1(h) different successors of h:

    p(w | u v) = max(c(u, v, w) - D, 0) / c(u, v) + D * N1(u, v) / c(u, v) * p(w | v),
    p(w | v) = max(c(v, w) - D, 0) / c(v) + D * N1(v) / c(v) * p1(w),    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

and the lower order alone after a context that training does not have. A text starts in the context of an end; its first
token has no longer one. The first terms are what the trie holds as probabilities, the factors are its back-off weights.
Codes are the same in every shard and model, so scores depend neither on shards nor on where words lie. Contexts of a large
share of all tokens are dealt out by the word that follows, not by themselves. Words are known by 64
bits of hash, within a context by 40 and within a pair by 32.
"""

from __future__ import annotations

import io
import mmap
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, trim

PACK_TOKENS = 1_250_000
SHARD_TOKENS = 2_000_000
DISCOUNT = 0.75
#: N-grams that are looked up at a time.
STEP = 500_000
#: Contexts of at least this share of tokens, in a sample of about so many rows (drawn by a hash), are dealt out by their successors.
#: This places work and changes no result.
HOT_SHARE = 0.002
HOT_ROWS = 2_000
END = b""

#: The place of the r-th set bit of each byte, at 8 * byte + r.
_NTH = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8).ravel()
_L, _H, _5, _3, _F = (np.uint64(int(x * 8, 16)) for x in ("01", "80", "55", "33", "0f"))
_U = [np.uint64(i) for i in range(9)]


#: Ratios of counts up to so many are exact codes of their own; n-grams and contexts seen this often get finer codes.
EXACT, FINE_COUNT, FINE_CONTEXT = 15, 4, 16
ESCAPE = 255
_RATIOS = EXACT * (EXACT + 1) // 2
#: Bounds of the other codes in -log2, for counts below FINE_COUNT of more than EXACT: steps of 0.1 up to 13.9, wider ones up to 40.
_BINS = np.concatenate([np.linspace(2.4, 13.9, 116), np.linspace(13.9, 20, 13)[1:], np.linspace(20, 40, ESCAPE - 1 - _RATIOS - 127 + 1)[1:]])
#: Steps of the finer code in one of -log2.
_FINE = 1 << 10


def coded(part: np.ndarray, whole: np.ndarray, value: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Codes of ``value``, which follows from two counts: the byte, and above it 32 bits more where the byte is ESCAPE.

    The codes are the same for every model: ratios of counts up to EXACT are exact, else a bin of logarithms, and where
    ``fine`` is true a logarithm to one part in two thousand. So a score depends on nothing but the counts. Code 0 is no value.
    """
    part, whole = part.astype(np.int64), whole.astype(np.int64)
    depth = -np.log2(np.where(value > 0, value, 1.0))
    bins = _RATIOS + np.clip(np.searchsorted(_BINS, depth, side="right"), 1, len(_BINS) - 1)
    out = np.where(whole <= EXACT, whole * (whole - 1) // 2 + part, np.where(fine, ESCAPE, bins)).astype(np.uint64)
    deep = out == ESCAPE
    out[deep] |= np.minimum(np.rint(depth[deep] * _FINE), 0xFFFFFFFF).astype(np.uint64) << np.uint64(8)
    return np.where(value > 0, out, 0).astype(np.uint64)


def decoded(codes: np.ndarray, ratio) -> np.ndarray:
    """Values of codes; ``ratio(part, whole)`` is what two small counts stand for."""
    small = [(p, w) for w in range(1, EXACT + 1) for p in range(1, w + 1)]
    plain = np.zeros(ESCAPE + 1)
    plain[1 : _RATIOS + 1] = [ratio(p, w) for p, w in small]
    plain[_RATIOS + 1 : ESCAPE] = np.exp2(-(_BINS[1:] + _BINS[:-1]) / 2)
    byte = (codes & np.uint64(255)).astype(np.int64)
    return np.where(byte == ESCAPE, np.exp2(-(codes >> np.uint64(8)).astype(float) / _FINE), plain[byte])


def _pack_codes(codes: np.ndarray) -> bytes:
    """The bytes of codes, and what stands above those that are ESCAPE."""
    byte = (codes & np.uint64(255)).astype(np.uint8)
    more = (codes[byte == ESCAPE] >> np.uint64(8)).astype(np.uint32)
    return byte.tobytes() + struct.pack("<I", len(more)) + _planes(more)


class EliasFano:
    """A sorted sequence of 64-bit numbers: low bytes as they are, high parts as gaps in unary.

    Numbers are selected and searched on the packed bits; beside them there is one running count for each 64 of them.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.words = n, width, low, high
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.uint32), dtype=np.uint32)])

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        """The sequence as bytes, of a length that is a multiple of 8."""
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(7, max(0, -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8)))
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width] if n else np.zeros((0, width), np.uint8)
        bits = np.zeros(-(-((top >> (8 * width)) + n + 1) // 64) * 64, bool)
        if n:
            bits[(values >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little")
        body = struct.pack("<QQQ", n, width, len(high)) + high.tobytes() + low.tobytes()
        return body + bytes(-len(body) % 8)

    @staticmethod
    def load(buffer, at: int) -> tuple[EliasFano, int]:
        """(sequence over the mapped bytes, where the next one begins)."""
        n, width, size = struct.unpack_from("<QQQ", buffer, at)
        high = np.frombuffer(buffer, "<u8", size // 8, at + 24)
        low = np.frombuffer(buffer, np.uint8, n * width, at + 24 + size).reshape(n, width) if n * width else np.zeros((n, 0), np.uint8)
        end = at + 24 + n * width + size
        return EliasFano(n, width, low, high), end + -(end - at) % 8

    def _select(self, index: np.ndarray, zeros: bool) -> np.ndarray:
        """The place of the index-th set (or clear) bit, from 0; the number of bits where there is none."""
        if zeros:
            before = np.arange(len(self.words) + 1, dtype=np.int64) * 64 - self.before
        else:
            before = self.before
        word = np.searchsorted(before, index, "right") - 1
        inside = word < len(self.words)
        out = np.full(len(index), len(self.words) * 64, np.int64)
        word = word[inside]
        bits = ~self.words[word] if zeros else self.words[word]
        left = (index[inside] - before[word]).astype(np.uint64)
        sums = bits - ((bits >> _U[1]) & _5)
        sums = (sums & _3) + ((sums >> _U[2]) & _3)
        sums = ((sums + (sums >> _U[4])) & _F) * _L  # set bits up to each byte's end
        skip = np.bitwise_count(((left * _L | _H) - sums) & _H).astype(np.uint64) * _U[8]
        left -= ((sums << _U[8]) >> skip) & np.uint64(255)
        out[inside] = word * 64 + (skip.astype(np.int64) + _NTH[(((bits >> skip) & np.uint64(255)) * _U[8] + left).astype(np.int64)])
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        high = (self._select(index, False) - index).astype(np.uint64)
        return self._low(index) | (high << np.uint64(8 * self.width))

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below: the set bits before the high-th clear one."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        out[some] = np.minimum(self._select(high[some] - 1, True) - (high[some] - 1), self.n)
        return out

    def successor(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the first place in [begin, end) whose number is not less (``end`` if there is none), and whether it is the value.

        Numbers of equal high part are a run of places, in which the low parts alone decide.
        """
        high = (values >> np.uint64(8 * self.width)).astype(np.int64)
        low = values & np.uint64((1 << (8 * self.width)) - 1)
        begin = np.minimum(np.maximum(begin, self._upto(high)), end)
        stop = np.minimum(np.maximum(np.minimum(end, self._upto(high + 1)), begin), end)
        past = stop.copy()
        while True:
            open_ = np.flatnonzero(begin < stop)
            if not len(open_):
                break
            middle = (begin[open_] + stop[open_]) >> 1
            less = self._low(middle) < low[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            stop[open_] = np.where(less, stop[open_], middle)
        same = np.flatnonzero(begin < past)
        equal = np.zeros(len(values), bool)
        equal[same] = self._low(begin[same]) == low[same]
        return begin, equal

    def _low(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros((len(index), 8), np.uint8)
        out[:, : self.width] = self.low[index]
        return out.view("<u8").ravel()


def _find(level: EliasFano, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of each number within its range; -1 where it is not."""
    spot, equal = level.successor(wanted, begin, end)
    return np.where(equal, spot, -1)


class Trie:
    """Contexts, their successors and the successors of pairs, with pointers, probabilities and weights, in one memory-mapped file."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.contexts, at = EliasFano.load(self.map, 0)
        self.pointers, at = EliasFano.load(self.map, at)
        self.pairs, at = EliasFano.load(self.map, at)
        self.ends, at = EliasFano.load(self.map, at)
        self.triples, at = EliasFano.load(self.map, at)
        self.codes, self.weights, self.leaves = [], [], []
        for held, n in ((self.codes, self.pairs.n), (self.weights, self.pairs.n), (self.leaves, self.triples.n)):
            (more,) = struct.unpack_from("<Q", self.map, at)
            held += [np.frombuffer(self.map, np.uint8, n, at + 8), np.frombuffer(self.map, "<u4", more, at + 8 + n + -n % 8), np.frombuffer(self.map, "<u4", more, at + 8 + n + -n % 8 + 4 * more)]
            at += 8 + n + -n % 8 + 8 * more

    @staticmethod
    def write(path: str, contexts: np.ndarray, pairs: np.ndarray, triples: np.ndarray, codes: np.ndarray, weights: np.ndarray, leaves: np.ndarray) -> None:
        """Sorted contexts; pairs as context's place << 40 | word; triples as pair's place << 32 | word; codes of pairs and triples.

        Codes are bytes; beside them stand the places of those that are ESCAPE, and what they stand for.

        A level's numbers stand relative to their context, which is their upper part.
        """
        first = np.searchsorted((pairs >> np.uint64(40)).astype(np.int64), np.arange(len(contexts) + 1))
        second = np.searchsorted((triples >> np.uint64(32)).astype(np.int64), np.arange(len(pairs) + 1))
        with open(path, "wb") as f:
            for x in (contexts, first, pairs, second, triples):
                f.write(EliasFano.build(x.astype(np.uint64)))
            for x in (codes, weights, leaves):
                byte = (x.astype(np.uint64) & np.uint64(255)).astype(np.uint8)
                at = np.flatnonzero(byte == ESCAPE)
                f.write(struct.pack("<Q", len(at)) + byte.tobytes() + bytes(-len(byte) % 8) + at.astype("<u4").tobytes() + (x.astype(np.uint64)[at] >> np.uint64(8)).astype("<u4").tobytes())
            f.write(bytes(8))

    @staticmethod
    def _codes(held: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """The codes at some places."""
        out = held[0][places].astype(np.uint64)
        deep = np.flatnonzero(out == ESCAPE)
        out[deep] |= held[2][np.searchsorted(held[1], places[deep])].astype(np.uint64) << np.uint64(8)
        return out

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each (context, word) among the pairs; -1 where the trie does not have it."""
        out = np.full(len(words), -1, np.int64)
        if not self.pairs.n:
            return out
        rank = _find(self.contexts, contexts, np.zeros(len(words), np.int64), np.full(len(words), self.contexts.n))
        there = np.flatnonzero(rank >= 0)
        rank = rank[there]
        begin, end = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
        out[there] = _find(self.pairs, (rank.astype(np.uint64) << np.uint64(40)) | words[there], begin, end)
        return out

    def follow(self, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each word after the pair at a place; 0 where the trie does not have it."""
        out = np.zeros(len(words), np.uint64)
        there = np.flatnonzero(places >= 0)
        if not self.triples.n or not len(there):
            return out
        place = places[there]
        begin, end = self.ends.get(place).astype(np.int64), self.ends.get(place + 1).astype(np.int64)
        spot = _find(self.triples, (place.astype(np.uint64) << np.uint64(32)) | words[there], begin, end)
        out[there[spot >= 0]] = self._codes(self.leaves, spot[spot >= 0])
        return out

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability's code, weight's code) of the pairs at some places; 0 for -1."""
        there, out = np.flatnonzero(places >= 0), np.zeros((2, len(places)), np.uint64)
        if self.pairs.n:
            out[0, there], out[1, there] = self._codes(self.codes, places[there]), self._codes(self.weights, places[there])
        return out[0], out[1]

    def close(self) -> None:
        """Give the file back; arrays that view it must be gone."""
        self.contexts = self.pointers = self.pairs = self.ends = self.triples = self.codes = self.weights = self.leaves = None
        self.map.close()
        self.file.close()


# Packs --------------------------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


_MASK = np.uint64((1 << 40) - 1)


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) if word else 0


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _loosen(data) -> memoryview:
    return memoryview(zstandard.ZstdDecompressor().decompress(data))


def _counts(values: np.ndarray) -> bytes:
    """Counts as bytes, with the large ones apart."""
    large = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8).tobytes() + struct.pack("<I", len(large)) + large.astype(np.uint32).tobytes() + values[large].astype(np.uint32).tobytes()


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, all second bytes, and so on, which compress on their own."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _merged(data, kind, n: int) -> np.ndarray:
    """Numbers from their planes."""
    return np.frombuffer(bytes(data), np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).ravel()


class _Reader:
    """Arrays one after another in a block of bytes."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, kind, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        out = np.frombuffer(bytes(self.data[self.at : self.at + size]), kind)
        self.at += size
        return out

    def planes(self, kind, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        out = _merged(self.data[self.at : self.at + size], kind, n)
        self.at += size
        return out

    def counts(self, n: int) -> np.ndarray:
        out = self.take(np.uint8, n).astype(np.int64)
        (m,) = self.take(np.uint32, 1)
        at = self.take(np.uint32, int(m))
        out[at] = self.take(np.uint32, int(m))
        return out


    def codes(self, n: int) -> np.ndarray:
        out = self.take(np.uint8, n).astype(np.uint64)
        (m,) = self.take(np.uint32, 1)
        out[out == ESCAPE] |= self.planes(np.uint32, int(m)).astype(np.uint64) << np.uint64(8)
        return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as its count, one run after another."""
    past = np.cumsum(counts)
    return np.repeat(starts - (past - counts), counts) + np.arange(int(past[-1]) if len(past) else 0)


class _Ngrams:
    """The distinct pairs and triples of a pack, in the order in which shards are asked.

    ``flat`` numbers the tokens by the words' hashes, ``starts`` are the texts' first tokens, ``is_hot`` marks words that are
    dealt out by their successors. Pairs are sorted by context and word; triples by pair and word.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, end: int, n: int, is_hot: np.ndarray):
        context = np.empty_like(flat)
        context[1:] = flat[:-1]
        context[starts] = end
        pair, self.pair_of = np.unique(context.astype(np.uint64) * np.uint64(n) + flat.astype(np.uint64), return_inverse=True)
        self.head, self.tail = (pair // np.uint64(n)).astype(np.int64), (pair % np.uint64(n)).astype(np.int64)
        inner = np.ones(len(flat), bool)
        inner[starts] = False
        self.inner = np.flatnonzero(inner)  # tokens with a context of two
        triple, self.triple_of = np.unique(self.pair_of[self.inner - 1].astype(np.uint64) * np.uint64(n) + flat[self.inner].astype(np.uint64), return_inverse=True)
        self.over, self.last = (triple // np.uint64(n)).astype(np.int64), (triple % np.uint64(n)).astype(np.int64)
        busy = is_hot[self.head]
        self.cold, warm = np.flatnonzero(~busy), np.flatnonzero(busy)
        self.warm = warm[np.argsort(self.tail[warm], kind="stable")]
        self.follow = np.bincount(self.over, minlength=len(pair))
        first = np.cumsum(self.follow) - self.follow
        self.cold_triples, self.warm_triples = (_ranges(first[x], self.follow[x]) for x in (self.cold, self.warm))


def _requests(docs: DataFrame, keep: list[str], shards: int, hot: list[bytes]) -> DataFrame:
    """Rows (key, kind, blob): kind 0 asks a shard, kind 1 carries a pack's tokens."""
    hot_hashes = np.unique(np.array([_hash(w) for w in hot], np.uint64))
    shift = np.uint64(64 - (shards - 1).bit_length()) if shards > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        numbers = _Numbers()
        tokens: list[np.ndarray] = []
        kept: list[pa.RecordBatch] = []
        trained: list[bool] = []
        held, packs = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, packs
            table = pa.Table.from_batches(kept)
            hashes = np.fromiter(map(_hash, numbers), np.uint64, len(numbers))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            hashes = hashes[order]
            flat = place[np.concatenate(tokens)]
            lengths = np.array([len(t) for t in tokens], np.int64)
            starts = np.cumsum(lengths) - lengths
            end = int(place[numbers[END]])
            train = np.repeat(np.array(trained, np.int64), lengths)
            n = len(hashes)
            unigrams = np.bincount(flat, train, minlength=n).astype(np.int64)
            spot = np.minimum(np.searchsorted(hot_hashes, hashes), max(len(hot_hashes) - 1, 0))
            is_hot = hot_hashes[spot] == hashes if len(hot_hashes) else np.zeros(n, bool)
            g = _Ngrams(flat, starts, end, n, is_hot)
            bigrams = np.bincount(g.pair_of, train, minlength=len(g.head)).astype(np.int64)
            trigrams = np.bincount(g.triple_of, train[g.inner], minlength=len(g.over)).astype(np.int64)
            edges = np.searchsorted(hashes, np.arange(1, shards, dtype=np.uint64) << shift) if shards > 1 else np.zeros(0, np.int64)
            edges = np.concatenate([[0], edges, [n]]).astype(np.int64)
            cold_edges, warm_edges = np.searchsorted(g.head[g.cold], edges), np.searchsorted(g.tail[g.warm], edges)
            past = [np.concatenate([[0], np.cumsum(g.follow[x])]) for x in (g.cold, g.warm)]
            number = int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes() + flat.tobytes() + struct.pack("<qq", part, packs)), "little") >> 1
            rows = []
            for s in range(shards):
                i, j = edges[s], edges[s + 1]
                own, hots = g.cold[cold_edges[s] : cold_edges[s + 1]], g.warm[warm_edges[s] : warm_edges[s + 1]]
                below = np.concatenate([g.cold_triples[past[0][cold_edges[s]] : past[0][cold_edges[s + 1]]], g.warm_triples[past[1][warm_edges[s]] : past[1][warm_edges[s + 1]]]])
                follow = np.bincount(g.head[own] - i, minlength=j - i)
                words = hashes[g.tail[own]] & _MASK
                blob = b"".join([
                    struct.pack("<qIIII", number, j - i, len(own), len(hots), len(below)), _planes(np.diff(hashes[i:j], prepend=np.uint64(0))), _counts(unigrams[i:j]), _counts(follow),
                    (words & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (words >> np.uint64(32)).astype(np.uint8).tobytes(), _counts(bigrams[own]),
                    spot[g.head[hots]].astype(np.uint16).tobytes(), (g.tail[hots] - i).astype(np.uint32).tobytes(), _counts(bigrams[hots]),
                    _counts(g.follow[np.concatenate([own, hots])]), (hashes[g.last[below]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), _counts(trigrams[below]),
                ])
                rows.append((s, 0, _squeeze(blob)))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            side = sink.getvalue()
            # Tokens go as ranks by frequency, whose upper bytes are mostly zero.
            common = np.argsort(-np.bincount(flat, minlength=n), kind="stable")
            rank = np.empty(n, np.int64)
            rank[common] = np.arange(n)
            blob = struct.pack("<qIIII", number, len(flat), len(lengths), end, len(side)) + side + lengths.astype(np.uint32).tobytes() + np.where(is_hot, spot, -1).astype(np.int16).tobytes() + _planes(common.astype(np.uint32)) + _planes(rank[flat].astype(np.uint32))
            rows.append((number % shards, 1, _squeeze(blob)))
            numbers.clear()
            tokens.clear()
            kept.clear()
            trained.clear()
            held, packs = 0, packs + 1
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "kind", "blob"])

        for batch in batches:
            flags = batch.column(batch.schema.get_field_index("__train")).to_pylist()
            side = batch.select(keep)
            for start, texts in slices(batch, "text"):
                kept.append(side.slice(start, len(texts)))
                for i, text in enumerate(texts):
                    words = text.lower().split()
                    words.append(END)
                    tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    trained.append(bool(flags[start + i]))
                    held += len(words)
                if held >= PACK_TOKENS:
                    yield flush()
        if tokens:
            yield flush()
        trim()

    return docs.mapInArrow(run, "key int, kind int, blob binary")


def _probability(count: np.ndarray, context: np.ndarray, discount: float) -> np.ndarray:
    """Codes of discounted probabilities."""
    return coded(count, context, np.maximum(count - discount, 0) / np.maximum(context, 1), count >= FINE_COUNT)


def _answer(hots: int, discount: float):
    """One shard: add the counts of all packs, build the trie, answer each pack."""

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        packs, hashes, counts, contexts, words, pair_counts, follows, lasts, triple_counts = ([] for _ in range(9))
        shard = table.column("key")[0].as_py()
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            data = _loosen(blob.as_buffer())
            if kind == 1:
                rows.append((struct.unpack_from("<q", data)[0], -1, bytes(blob.as_buffer())))
                continue
            number, n, cold, hot, below = struct.unpack_from("<qIIII", data)
            r = _Reader(data)
            r.at = 24
            own = np.cumsum(r.planes(np.uint64, n), dtype=np.uint64)
            unigrams, follow = r.counts(n), r.counts(n)
            low = r.take(np.uint32, cold).astype(np.uint64) | (r.take(np.uint8, cold).astype(np.uint64) << np.uint64(32))
            cold_counts = r.counts(cold)
            which, tail = r.take(np.uint16, hot), r.take(np.uint32, hot)
            hot_counts = r.counts(hot)
            follows.append(r.counts(cold + hot))
            lasts.append(r.take(np.uint32, below))
            triple_counts.append(r.counts(below))
            packs.append((number, n, cold, hot))
            hashes.append(own)
            counts.append(unigrams)
            contexts.append((np.repeat(np.arange(n), follow), which.astype(np.int64)))
            words.append(np.concatenate([low, own[tail] & _MASK]))
            pair_counts.append(np.concatenate([cold_counts, hot_counts]))
        if not packs:
            return _table(rows)
        vocabulary, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), minlength=len(vocabulary)).astype(np.int64)
        edges = np.cumsum([0, *(p[1] for p in packs)])
        # A context's rank among this shard's: those dealt out by successor first, then the shard's words.
        ranks = [np.concatenate([hots + inverse[edges[k] + place], which]) for k, (place, which) in enumerate(contexts)]
        del contexts, hashes, counts
        keys, where = np.unique((np.concatenate(ranks).astype(np.uint64) << np.uint64(40)) | np.concatenate(words), return_inverse=True)
        del ranks, words
        sums = np.bincount(where, np.concatenate(pair_counts), minlength=len(keys)).astype(np.int64)
        below, back = np.unique((np.repeat(where, np.concatenate(follows)).astype(np.uint64) << np.uint64(32)) | np.concatenate(lasts), return_inverse=True)
        below_sums = np.bincount(back, np.concatenate(triple_counts), minlength=len(below)).astype(np.int64)
        where, back = where.astype(np.uint32), back.astype(np.uint32)
        del pair_counts, triple_counts
        every, every_below = keys, below
        seen, deep = sums > 0, below_sums > 0
        sums, below_sums, below = sums[seen], below_sums[deep], below[deep]
        over = (np.cumsum(seen) - 1)[(below >> np.uint64(32)).astype(np.int64)]
        keys = keys[seen]
        head = (keys >> np.uint64(40)).astype(np.int64)
        size = hots + len(vocabulary)
        held, types = np.bincount(head, sums, minlength=size), np.bincount(head, minlength=size)
        after, kinds = np.bincount(over, below_sums, minlength=len(keys)), np.bincount(over, minlength=len(keys))
        # A shard has but its share of a context that is dealt out: there the code is the count.
        counted = np.where(sums < ESCAPE, sums, ESCAPE | (sums << 8)).astype(np.uint64)
        codes = np.where(head < hots, counted, _probability(sums, held[head], discount))
        leaves = _probability(below_sums, after[over], discount)
        some = np.maximum(after, 1)
        weights = coded(kinds, some, np.where(after > 0, discount * kinds / some, 0.0), after >= FINE_CONTEXT)
        present, place = np.unique(head, return_inverse=True)
        with tempfile.TemporaryDirectory(prefix="trie-") as folder:
            path = os.path.join(folder, "levels")
            Trie.write(path, present, (place.astype(np.uint64) << np.uint64(40)) | (keys & _MASK), (over.astype(np.uint64) << np.uint64(32)) | (below & np.uint64(0xFFFFFFFF)), codes, weights, leaves)
            del keys, sums, below, below_sums, over, head, place
            trie = Trie(path)
            # Each distinct pair and triple is looked up once, in order.
            found = np.concatenate([trie.find(x >> np.uint64(40), x & _MASK) for x in np.array_split(every, 1 + len(every) // STEP)])
            all_codes, all_weights = trie.at(found)
            all_leaves = np.concatenate([trie.follow(found[(x >> np.uint64(32)).astype(np.int64)], x & np.uint64(0xFFFFFFFF)) for x in np.array_split(every_below, 1 + len(every_below) // STEP)])
            del every, every_below, found
            at_pair = at_triple = 0
            for k, (number, n, cold, hot) in enumerate(packs):
                mine = where[at_pair : at_pair + cold + hot]
                pair_codes, pair_weights = all_codes[mine], all_weights[mine]
                triple_codes = all_leaves[back[at_triple : at_triple + len(lasts[k])]]
                at_pair, at_triple = at_pair + cold + hot, at_triple + len(lasts[k])
                mine = inverse[edges[k] : edges[k + 1]]
                cold_below = int(follows[k][:cold].sum())
                blob = b"".join([
                    struct.pack("<IIIIIqq", n, cold, hot, cold_below, len(triple_codes) - cold_below, int(total.sum()), int((total > 0).sum())), _planes(total[mine].astype(np.uint64)), _planes(types[hots + mine].astype(np.uint32)),
                    types[:hots].astype(np.uint32).tobytes(), held[:hots].astype(np.float64).tobytes(), _pack_codes(pair_codes), _pack_codes(pair_weights), _pack_codes(triple_codes),
                ])
                rows.append((number, shard, _squeeze(blob)))
            trie.close()
        del inverse, follows, lasts, where, back
        trim()
        return _table(rows)

    return run


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _sums(keep: list[str], shards: int, hots: int, discount: float):
    """One pack: its documents' scores from the answers of all shards."""

    def run(table: pa.Table) -> pa.Table:
        answers: dict[int, memoryview] = {}
        data = None
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            if kind < 0:
                data = _loosen(blob.as_buffer())
            else:
                answers[kind] = _loosen(blob.as_buffer())
        if data is None or len(answers) != shards:
            raise RuntimeError(f"a pack has {len(answers)} of {shards} answers")
        _, n_tokens, n_docs, end, side = struct.unpack_from("<qIIII", data)
        at = 24
        kept = pa.ipc.open_stream(pa.BufferReader(bytes(data[at : at + side]))).read_all()
        r = _Reader(data)
        r.at = at + side
        lengths = r.take(np.uint32, n_docs).astype(np.int64)
        parts = [answers[s] for s in range(shards)]
        layout = "<IIIIIqq"
        heads = [struct.unpack_from(layout, p) for p in parts]
        n = sum(h[0] for h in heads)
        hot_number = r.take(np.int16, n).astype(np.int64)
        is_hot = hot_number >= 0
        common = r.planes(np.uint32, n).astype(np.int64)
        flat = common[r.planes(np.uint32, n_tokens)]
        total_n, total_v = sum(h[5] for h in heads), sum(h[6] for h in heads)
        counts, types = [], []
        cold_p, warm_p, cold_w, warm_w, cold_t, warm_t = ([] for _ in range(6))
        hot_types, hot_held = np.zeros(hots, np.int64), np.zeros(hots)
        for p, (words, cold, warm, cold_below, warm_below, _, _) in zip(parts, heads, strict=True):
            r = _Reader(p)
            r.at = struct.calcsize(layout)
            counts.append(r.planes(np.uint64, words).astype(np.int64))
            types.append(r.planes(np.uint32, words).astype(np.int64))
            hot_types += r.take(np.uint32, hots).astype(np.int64)
            hot_held += r.take(np.float64, hots)
            codes = r.codes(cold + warm)
            cold_p.append(codes[:cold])
            warm_p.append(codes[cold:])
            codes = r.codes(cold + warm)
            cold_w.append(codes[:cold])
            warm_w.append(codes[cold:])
            codes = r.codes(cold_below + warm_below)
            cold_t.append(codes[:cold_below])
            warm_t.append(codes[cold_below:])
        count, kinds = np.concatenate(counts), np.concatenate(types)
        kinds[is_hot] = hot_types[hot_number[is_hot]]
        starts = np.cumsum(lengths) - lengths
        g = _Ngrams(flat, starts, end, n, is_hot)
        ratio, share = (lambda c, n: max(c - discount, 0) / n), (lambda k, n: discount * k / n)
        own, weight, triple = np.zeros(len(g.head)), np.zeros(len(g.head)), np.zeros(len(g.over))
        own[g.cold], weight[g.cold], triple[g.cold_triples] = decoded(np.concatenate(cold_p), ratio), decoded(np.concatenate(cold_w), share), decoded(np.concatenate(cold_t), ratio)
        weight[g.warm], triple[g.warm_triples] = decoded(np.concatenate(warm_w), share), decoded(np.concatenate(warm_t), ratio)
        # Counts after a context that is dealt out become the codes that they would be in one shard.
        counted = np.concatenate(warm_p)
        counted = np.where(counted & np.uint64(255) == ESCAPE, counted >> np.uint64(8), counted).astype(np.int64)
        own[g.warm] = decoded(_probability(counted, hot_held[hot_number[g.head[g.warm]]], discount), ratio)
        p1 = (count + 0.5) / (total_n + 0.5 * (total_v + 1))
        below = count[g.head]
        safe = np.where(below > 0, below, 1)
        p2 = np.where(below > 0, own + discount * kinds[g.head] / safe * p1[g.tail], p1[g.tail])
        p = p2[g.pair_of]
        back = weight[g.over]
        p[g.inner] = triple[g.triple_of] + np.where(back > 0, back, 1.0)[g.triple_of] * p[g.inner]
        owner = np.repeat(np.arange(n_docs), lengths)
        base = np.bincount(owner, np.log10(p1)[flat], minlength=n_docs)
        score = np.bincount(owner, np.log10(p), minlength=n_docs)
        known_tokens = np.bincount(owner, (count > 0)[flat], minlength=n_docs).astype(np.int64)
        out = {name: kept.column(name) for name in keep}
        del g, flat, p, p2
        trim()
        return pa.table(out | {"n_tokens": lengths, "n_known": known_tokens, "train_tokens": np.full(n_docs, total_n), "base_score": base, "score": score})

    return run



_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def frequent_contexts(docs: DataFrame, rows: int) -> list[bytes]:
    """Words of at least HOT_SHARE of the tokens of a sample drawn by a hash of the text; at most 1 / HOT_SHARE of them."""
    drawn = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < int(np.ceil(min(1.0, HOT_ROWS / max(rows, 1)) * (1 << 20)))
    some = docs.select("text").where(drawn)
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = some.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "w").limit(int(1 / HOT_SHARE)).collect()
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [r["w"].encode() for r in top if r["n"] >= HOT_SHARE * total]


def lm_scores(docs: DataFrame, train: Column, keep: tuple[str, ...] = ("doc_id",), discount: float = DISCOUNT) -> DataFrame:
    """Score each row's ``text`` with a model learnt from the rows where ``train`` is true.

    Returns ``keep``, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the model), log10. A null or
    empty text has one token, its end. Where ``train`` is null the row does not train; repeated rows train as often as
    they stand there; equal texts get equal scores up to rounding; with no training rows all words are as likely; an
    empty table gives an empty result; columns other than ``keep`` and the text are ignored. Memory is bounded by packs
    and shards (one longer text is a pack of its own); both exchanges are linear in the input.
    """
    spark = docs.sparkSession
    prepare(spark)
    columns = list(keep)
    source = docs.select(*columns, "text", F.coalesce(train, F.lit(False)).alias("__train"))
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    tokens = size["rows"] + (size["bytes"] or 0) / 6
    shards = 1 << max(2, int(np.ceil(np.log2(max(1.0, tokens / SHARD_TOKENS)))))
    hot = frequent_contexts(docs, size["rows"])
    asked = _requests(source, columns, shards, hot).repartitionById(shards, "key")  # a task for each shard
    answered = asked.groupBy("key").applyInArrow(_answer(len(set(hot)), discount), "key long, kind int, blob binary")
    packs = max(8, int(np.ceil(tokens / PACK_TOKENS)))
    types = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in columns)
    done = answered.repartition(packs, "key").groupBy("key").applyInArrow(_sums(columns, shards, len(set(hot)), discount), f"{types}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done
