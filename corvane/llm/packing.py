"""Packing token sequences by swap-based local search.

Pieces are dealt into blocks. A block is filled best fit first, the longest piece to begin with; then its underfull bins
exchange pieces: the fullest of them takes a piece of another (a move), one for one of its own, two for one, or one for
two, whichever fills it best. The other bin is never fuller, so each exchange raises the sum of squared fills: slack
gathers in few bins, and these run empty. Bins that stay underfull give their pieces to a further round of fewer blocks,
until one block is left or a round no longer empties bins.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, prepare

CAPACITY = 4096
BLOCK_PIECES = 4096
#: Bins with more room than this share of the capacity give their pieces to the next round.
ROOM_SHARE = 0.01
#: Parts of words whose ids a worker remembers, and the longest of them in bytes.
KNOWN_PARTS, KNOWN_BYTES = 600_000, 48


#: Classes of bytes: blank 0, letter 1, digit 2, other sign 3, and 4 for what leaves a word to the tokenizer.
_CLASS = np.array([0 if b in b" \t\n\r\x0b\x0c" else 4 if b < 32 or b > 126 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_parts(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, ends, plain): the lower-cased bytes and the parts that the tokenizer's pattern cuts them into, in order.

    Plain words consist of printable ASCII and letters of Latin-1, which no other rule of the tokenizer touches: letters in a
    row, single digits, other signs in a row, and 's 't 're 've 'm 'll 'd where the sign starts a run. Any other word is one part that is not plain.
    """
    text = np.frombuffer(joined.translate(_LOWER), np.uint8).copy()
    kind = _CLASS[text]
    lead = np.flatnonzero(text[:-1] == 0xC3)
    after = text[lead + 1]
    lead, after = lead[(after >= 0x80) & (after <= 0xBF)], after[(after >= 0x80) & (after <= 0xBF)]
    signs = (after == 0x97) | (after == 0xB7)  # times and division
    text[lead[(after <= 0x9E) & ~signs] + 1] += 0x20
    kind[lead] = kind[lead + 1] = np.where(signs, 3, 1)
    full = np.append(kind, 0)
    begins = np.flatnonzero((full[:-1] > 0) & (np.concatenate([[0], full[:-2]]) == 0))
    stops = np.flatnonzero((full[:-1] > 0) & (full[1:] == 0)) + 1
    odd = np.maximum.reduceat(kind, begins) == 4 if len(begins) else np.zeros(0, bool)
    mark = np.flatnonzero((text[:-1] == 60) & (text[1:] == 124))  # what may be an added token
    odd[np.searchsorted(begins, mark, side="right") - 1] = True
    new = np.zeros(len(text) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[:-1] |= kind == 2
    if len(text):
        new[0] = True
    run = np.flatnonzero((text[:-2] == 39) & new[:-3])
    one, two = text[run + 1], text[run + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    some = run[short | long]
    new[some + 1] = False
    new[some + np.where(short, 2, 3)[short | long]] = True
    first = np.zeros(len(text), bool)
    first[new[:-1] & (kind > 0)] = True
    for s, e in zip(begins[odd].tolist(), stops[odd].tolist(), strict=True):
        first[s:e] = False
        first[s] = True
    starts = np.flatnonzero(first)
    at = np.searchsorted(begins, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(text)), stops[at]) if len(starts) else starts
    return text, starts, ends, ~odd[at] if len(starts) else np.zeros(0, bool)


def part_keys(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each part of at most KNOWN_BYTES: its bytes for up to seven, else a hash of 63 bits.

    Two of a worker's 600,000 longer parts agree in it with a probability of about 2e-8.
    """
    out = sizes.astype(np.uint64)
    hashed = out ^ np.uint64(0xCBF29CE484222325)
    left = np.arange(len(starts))
    for k in range(KNOWN_BYTES):
        left = left[sizes[left] > k]
        if not len(left):
            break
        byte = text[starts[left] + k].astype(np.uint64)
        if k < 7:
            out[left] |= byte << np.uint64(8 + 8 * k)
        hashed[left] = (hashed[left] ^ byte) * np.uint64(0x100000001B3)
    mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(sizes <= 7, out & np.uint64(0x7FFFFFFFFFFFFFFF), mixed | np.uint64(1 << 63))


class Merger:
    """Byte-level merges with word ends over many parts of words at a time: each round merges the first pair of least rank of every part."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.inner = np.array([vocabulary.get(signs[b], -1) for b in range(256)], np.int32)
        self.final = np.array([vocabulary.get(signs[b] + suffix, -1) for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (right >= 0), self.order[at], self.NONE)

    def __call__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids) of parts of a text of at most KNOWN_BYTES."""
        lengths, got = np.zeros(len(starts), np.int64), []
        for low, high in ((1, 4), (5, 7), (8, 10), (11, 14), (15, 20), (21, KNOWN_BYTES)):
            rows = np.flatnonzero((sizes >= low) & (sizes <= high))
            if not len(rows):
                continue
            width = int(sizes[rows].max())
            line = np.arange(width)[None, :]
            inside = line < sizes[rows][:, None]
            raw = text[np.where(inside, starts[rows][:, None] + line, 0)]
            signs = np.where(inside, np.where(line == sizes[rows][:, None] - 1, self.final[raw], self.inner[raw]), -1)
            ids = self._merge(signs)
            lengths[rows] = (ids >= 0).sum(axis=1)
            got.append((rows, ids))
        at = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int32)
        for rows, ids in got:
            held = ids >= 0
            out[(at[rows][:, None] + np.arange(ids.shape[1])[None, :])[held]] = ids[held]
        return out, lengths

    def _merge(self, signs: np.ndarray) -> np.ndarray:
        """Rows of signs, filled up with -1, merged as far as they go."""
        out = np.full(signs.shape, -1, np.int32)
        rows = np.arange(len(signs))
        ranks = self._ranks(signs[:, :-1], signs[:, 1:])
        while signs.shape[1] > 1:
            n, width = signs.shape
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(n), at]
            over = least == self.NONE
            if over.any():
                out[rows[over], :width] = signs[over]
                rows, signs, ranks, at, least = rows[~over], signs[~over], ranks[~over], at[~over], least[~over]
                n = len(rows)
                if not n:
                    return out
            line = np.arange(n)
            signs = signs[np.arange(width)[None, :] != at[:, None] + 1].reshape(n, width - 1)
            signs[line, at] = self.made[least]
            ranks = ranks[np.arange(width - 1)[None, :] != at[:, None]].reshape(n, width - 2)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self._ranks(signs[some, at[some] - 1], signs[some, at[some]])
            some = np.flatnonzero(at < width - 2)
            ranks[some, at[some]] = self._ranks(signs[some, at[some]], signs[some, at[some] + 1])
        out[rows, :1] = signs
        return out


class WordCoder:
    """Ids of texts by a tokenizer, as little-endian unsigned 32-bit numbers, each word between blanks on its own.

    That holds where no added token has blanks in or around it and the tokenizer drops blanks before it splits, which a
    probe tests; else texts go to the tokenizer whole. Parts of plain words are merged many at a time where a probe gives
    the tokenizer's own ids; all other words go to the tokenizer.
    """

    PROBE = "It's a  x9-y\té, <|endoftext|> Ab\n\r<|start|>\x0b\x0c#1. We'LL 'dx ...!? Straße Élan ÷3×4 't''s naïve-ly co-op don't e.g., anthropomorphism 12,345.60 (see_this) @x"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        added, model = about.get("added_tokens") or [], about["model"]
        self.merger = None
        whole, words = self._ids(self.PROBE.encode()), self.PROBE.encode().split()
        fixed = model.get("dropout") is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
        self.by_word = fixed and whole.tolist() == [i for w in words for i in self._ids(w)]
        if self.by_word and model["type"] == "BPE" and all(t["content"].startswith("<|") for t in added) and not model.get("continuing_subword_prefix"):
            self.merger = Merger(model)
            self.clear()
            if any(self([w])[0].tolist() != self._ids(w).tolist() for w in [*words, self.PROBE.encode()]):
                self.merger = None

    def clear(self) -> None:
        """Forget all parts: sorted keys, and where the ids of each lie in one row."""
        self.keys, self.at, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int32)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.merger is None:
            return [np.concatenate([self._ids(w) for w in t.split()] or [np.zeros(0, np.int32)]) if self.by_word else self._ids(t) for t in texts]
        if len(self.keys) > KNOWN_PARTS:
            self.clear()
        raw = b"".join(t + b" " for t in texts)
        text, starts, ends, plain = word_parts(raw)
        sizes = ends - starts
        easy = np.flatnonzero(plain & (sizes <= KNOWN_BYTES))
        hard = np.flatnonzero(~(plain & (sizes <= KNOWN_BYTES)))
        keys, first, back = np.unique(part_keys(text, starts[easy], sizes[easy]), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        there[inside] = self.keys[place[inside]] == keys[inside]
        fresh = easy[first[~there]]
        if len(fresh):
            ids, lengths = self.merger(text, starts[fresh], sizes[fresh])
            at = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, ids])
            self.keys = np.insert(self.keys, place[~there], keys[~there])
            self.at, self.lengths = np.insert(self.at, place[~there], at), np.insert(self.lengths, place[~there], lengths)
            place = place + np.cumsum(~there) - ~there
        at, lengths = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[easy], lengths[easy] = self.at[place][back], self.lengths[place][back]
        own = [self._ids(raw[starts[i] : ends[i]]) for i in hard]
        lengths[hard] = [len(i) for i in own]
        at[hard] = len(self.flat) + np.cumsum(lengths[hard]) - lengths[hard]
        flat = np.concatenate([self.flat, *own]) if own else self.flat
        total = np.cumsum(lengths)
        ids = flat[np.repeat(at - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)]
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        return np.split(ids, np.append(0, total)[bounds][:-1])


_CODERS: dict[str, WordCoder] = {}


def cut_pieces(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = 1, ids: bool = False) -> DataFrame:
    """``keep`` with piece, start, length and ids_crc32 of each piece of each row's tokens, the end id last.

    Rows of more than ``capacity`` tokens are cut into pieces of so many, the last may be shorter. A null or empty text has
    the end id alone; repeated rows are cut row by row; an empty table gives an empty result; other columns are ignored.
    With ``ids`` the pieces' ids come along as an array.
    """
    def make():
        coder = _CODERS.setdefault(path, None) or WordCoder(path)
        _CODERS[path] = coder

        def work(texts: list[bytes]) -> dict[str, list]:
            lengths, sums, held = [], [], []
            for found in coder(texts):
                row = np.append(found, end_id).astype("<u4").tobytes()
                parts = [row[i : i + 4 * capacity] for i in range(0, len(row), 4 * capacity)]
                lengths.append([len(p) // 4 for p in parts])
                sums.append([zlib.crc32(p) for p in parts])
                held.append([np.frombuffer(p, "<u4").astype(np.int32) for p in parts] if ids else None)
            return {"__lengths": lengths, "__sums": sums, "__ids": held}

        return work

    fields = [("__lengths", pa.list_(pa.int32())), ("__sums", pa.list_(pa.int64())), ("__ids", pa.list_(pa.list_(pa.int32())))]
    rows = per_text(docs, list(keep), make, fields, "__lengths array<int>, __sums array<long>, __ids array<array<int>>")
    pieces = rows.select(*keep, "__sums", "__ids", F.posexplode("__lengths").alias("piece", "length"))
    more = [F.get("__ids", F.col("piece")).alias("ids")] if ids else []
    return pieces.select(*keep, "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("length").cast("long").alias("length"), F.get("__sums", F.col("piece")).alias("ids_crc32"), *more)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: the longest first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, (size, -1))
        if at == len(rooms):
            room, k = capacity, len(bins)
            bins.append([])
        else:
            room, k = rooms.pop(at)
        bins[k].append(i)
        if room > size:
            insort(rooms, (room - size, k))
    return bins


class Exchange:
    """Underfull bins of one block that swap pieces."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.size, self.bins, self.capacity = lengths.tolist(), bins, capacity
        self.fill = [sum(self.size[i] for i in b) for b in bins]
        self.have = np.zeros(capacity + 1, np.int64)  # pieces of each length in bins that may give
        self.where: dict[int, set[int]] = {}
        self.pairs: dict[int, np.ndarray] = {}

    def _count(self, k: int, sign: int) -> None:
        for i in self.bins[k]:
            self.have[self.size[i]] += sign
        for size in {self.size[i] for i in self.bins[k]}:
            if sign > 0:
                self.where.setdefault(size, set()).add(k)
            else:
                self.where[size].discard(k)
        self.pairs.pop(k, None)

    def _sums(self, k: int) -> np.ndarray:
        """Columns (sum, bin, shorter) for all pairs of different pieces of a bin, one for each pair of lengths."""
        got = self.pairs.get(k)
        if got is None:
            sizes, times = np.unique([self.size[i] for i in self.bins[k]], return_counts=True)
            a, b = np.triu_indices(len(sizes))
            good = (a != b) | (times[a] > 1)
            a, b = a[good], b[good]
            got = self.pairs[k] = np.stack([sizes[a] + sizes[b], np.full(len(a), k), sizes[a]]) if len(a) else np.zeros((3, 0), np.int64)
        return got

    def _take(self, k: int, size: int) -> int:
        i = next(i for i in self.bins[k] if self.size[i] == size)
        self.bins[k].remove(i)
        return i

    def _best(self, k: int, open_bins: set[int]) -> tuple[int, tuple[int, ...], tuple[int, ...], int] | None:
        """(gain, lengths given, lengths taken, from which bin): what fills bin k most."""
        room = self.capacity - self.fill[k]
        at = np.where(self.have > 0, np.arange(self.capacity + 1), 0)
        below = np.maximum.accumulate(at)
        own = sorted({self.size[i] for i in self.bins[k]})
        best = (0, (), (), -1)
        for given, mine in [(0, ())] + [(a, (a,)) for a in own]:  # a move, one for one
            b = int(below[given + room])
            if b - given > best[0]:
                best = (b - given, mine, (b,), -1)
        if best[0] < room:  # one for two of mine
            mine = self._sums(k)
            if mine.shape[1]:
                got = below[np.minimum(mine[0] + room, self.capacity)] - mine[0]
                j = int(np.argmax(got))
                if got[j] > best[0]:
                    best = (int(got[j]), (int(mine[2, j]), int(mine[0, j] - mine[2, j])), (int(mine[0, j] + got[j]),), -1)
        if best[0] < room:  # two for one of mine, or for none
            sums = np.concatenate([self._sums(x) for x in open_bins] or [np.zeros((3, 0), np.int64)], axis=1)
            order = np.argsort(sums[0], kind="stable")
            sums = sums[:, order]
            for given in [0, *own]:
                j = int(np.searchsorted(sums[0], given + room, side="right")) - 1
                if j >= 0 and sums[0, j] - given > best[0]:
                    best = (int(sums[0, j]) - given, (given,) if given else (), (int(sums[2, j]), int(sums[0, j] - sums[2, j])), int(sums[1, j]))
        if not best[0]:
            return None
        gain, given, taken, source = best
        return gain, given, taken, source if source >= 0 else min(self.where[taken[0]], key=lambda x: (self.fill[x], x))

    def sweep(self) -> bool:
        """One pass from the fullest underfull bin to the emptiest; whether anything moved."""
        left = {k for k, f in enumerate(self.fill) if 0 < f < self.capacity}
        for k in left:
            self._count(k, 1)
        moved = False
        while len(left) > 1:
            k = max(left, key=lambda x: (self.fill[x], -x))
            left.remove(k)
            self._count(k, -1)
            while self.fill[k] < self.capacity:
                found = self._best(k, left)
                if found is None:
                    break
                gain, given, taken, other = found
                self._count(other, -1)
                out, into = [self._take(k, s) for s in given], [self._take(other, s) for s in taken]
                self.bins[k] += into
                self.bins[other] += out
                self.fill[k] += gain
                self.fill[other] -= gain
                self.pairs.pop(k, None)
                self._count(other, 1)
                if not self.bins[other]:
                    left.discard(other)
                moved = True
        for k in left:
            self._count(k, -1)
        return moved


def local_search(lengths: np.ndarray, capacity: int = CAPACITY, sweeps: int | None = None) -> list[list[int]]:
    """Bins of piece numbers; sweeps go on until none moves a piece (each raises the sum of squared fills)."""
    state = Exchange(lengths, best_fit(lengths, capacity), capacity)
    least = -(-int(lengths.sum()) // capacity)
    while sum(f > 0 for f in state.fill) > least and (sweeps is None or sweeps > 0) and state.sweep():
        sweeps = None if sweeps is None else sweeps - 1
    return [b for b in state.bins if b]


def _round(rows: DataFrame, blocks: int, number: int, capacity: int) -> DataFrame:
    """One round: every block on its own; adds sequence_id, offset and __fill."""
    prepare(rows.sparkSession)
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(number), "__row", "piece"), F.lit(blocks)).cast("int")) if blocks > 1 else rows.withColumn("__block", F.lit(0))
    names = [f.name for f in rows.schema]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__row", "piece"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        which, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for k, members in enumerate(local_search(lengths, capacity)):
            some = np.array(members)
            which[some], fill[some] = k, lengths[some].sum()
            offset[some] = np.cumsum(lengths[some]) - lengths[some]
        base = (number << 56) | (int(pdf["__block"].iloc[0]) << 24)
        return pdf[names].assign(sequence_id=base + which, offset=offset, __fill=fill)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long, __fill long"
    return dealt.groupBy("__block").applyInPandas(work, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK_PIECES, room: float = ROOM_SHARE) -> DataFrame:
    """Give each row a sequence_id and an offset, so that the lengths of a sequence make ``capacity`` at most.

    Takes any rows with ``length`` (1 to capacity) and ``piece``. Rows that fill a sequence alone are not dealt anywhere;
    the others meet in blocks of about ``block`` rows, drawn by a hash of the row's own number, so that equal rows spread.
    Nulls in other columns are carried along; repeated rows are packed one by one; an empty table gives an empty result.
    Only these rows move, never texts. Building the frame runs a job for each round.
    """
    rows = cut(pieces.withColumn("__row", F.monotonically_increasing_id()))
    whole = rows.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.col("__row"), "offset": F.lit(0).cast("long")})
    done, left, turn = [whole], rows.where(F.col("length") < capacity), 0
    count = left.count()
    while count:
        blocks = max(1, math.ceil(count / block))
        out = cut(_round(left, blocks, turn, capacity))
        again = F.col("__fill") < math.ceil(capacity * (1 - room))
        rest = out.where(again).count() if blocks > 1 else 0
        last = blocks == 1 or not rest or rest > count // 2
        done.append((out if last else out.where(~again)).drop("__fill"))
        if last:
            break
        left, count, turn = out.where(again).drop("sequence_id", "offset", "__fill"), rest, turn + 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.drop("__row")


def pack_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """``keep`` with piece, start, length, ids_crc32, sequence_id and offset: all pieces of all rows in few sequences.

    Nulls, empty texts, repeated rows, empty tables and other columns are as in ``cut_pieces`` and ``pack``.
    """
    return pack(cut_pieces(docs, path, keep, capacity, end_id), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that have their ``ids``: what a trainer reads. A sequence is as long as the capacity at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    made = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return made.select("sequence_id", "length", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
