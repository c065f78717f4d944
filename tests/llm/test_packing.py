"""Packing: ids against the library, bins against their bounds, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.packing import Exchange, WordCoder, best_fit, cut_pieces, local_search, pack, pack_documents, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hostile(seed, n):
    rng = random.Random(seed)
    signs = "aAbZzéÉßÿ÷×'’\"<|>0159²½.,;:-_#@\t\n\r \x0b\x0c\x00\x7f\x85\xa0…日İſΣσ́ 😀"
    words = ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "'LL", "don't", "''s", "''d've", "Straße", "x" * 60, "naïve", "é", "ΣΑΣ", "I'M", "'sx", "9's", "3'dd", "É'S"]
    return ["".join(rng.choice([rng.choice(signs), rng.choice(words), " "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    coder = WordCoder(PATH)
    assert coder.merger is not None
    texts = ["", " ", *hostile(1, 3000), "word " * 5000, "unbrokenword" * 3000]
    for t, got in zip(texts, coder([t.encode() for t in texts]), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_go_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, other = WordCoder(path), Tokenizer.from_file(path)
    texts = hostile(2, 200)
    assert coder.merger is None
    assert [g.tolist() for g in coder([t.encode() for t in texts])] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def squared(lengths, bins):
    return sum(int(lengths[b].sum()) ** 2 for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_search_never_lowers_squared_fill(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([rng.integers(1, 4096, 300), rng.integers(1200, 1500, 300), rng.integers(30, 3000, 300)])
    state = Exchange(lengths, best_fit(lengths, 4096), 4096)
    before = squared(lengths, [b for b in state.bins if b])
    for _ in range(20):
        if not state.sweep():
            break
        now = squared(lengths, [b for b in state.bins if b])
        assert now > before
        before = now
    assert sorted(i for b in state.bins for i in b) == list(range(300))
    assert all(int(lengths[b].sum()) == f <= 4096 for b, f in zip(state.bins, state.fill, strict=True))
    found = local_search(lengths)
    assert -(-int(lengths.sum()) // 4096) <= len(found) <= len([b for b in best_fit(lengths, 4096) if b])


@pytest.mark.parametrize(("lengths", "capacity", "bins"), [([2, 3, 4, 6, 10, 11], 18, 2), ([2, 3, 6, 7, 9, 11], 19, 2), ([3, 4, 6, 7, 7, 8, 9, 10, 10, 11, 11], 22, 4)])
def test_exchange_empties_bins_that_best_fit_leaves(lengths, capacity, bins):
    assert len(best_fit(np.array(lengths), capacity)) == bins + 1 and len(local_search(np.array(lengths), capacity)) == bins


def check(rows, texts, library, capacity):
    by_row, by_bin = {}, {}
    for r in rows:
        by_row.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for key, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(by_row[key], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        for r in mine:
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(part), zlib.crc32(part.tobytes()))
    for group in by_bin.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(by_bin), -(-total // capacity)


def test_whole_table(spark, library):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["one", "Two,", "é", "xyzzy", "12"], k=rng.choice([0, 1, 5, 40, 90, 700])))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "a " * 63), (1003, "a " * 64), (1004, "a " * 200)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"piece": F.lit("x"), "length": F.lit(0), "__row": F.lit(1)})
    rows = pack_documents(frame.repartition(3), PATH, capacity=64).collect()
    bins, least = check(rows, texts, library, 64)
    assert bins <= least * 1.02 + 1


def test_blocks_of_rounds_reach_nearly_the_bound(spark):
    rng = random.Random(6)
    pieces = spark.createDataFrame([(i, 0, rng.choice([rng.randrange(1, 4096), 100, 700, 4096])) for i in range(6000)], "doc_id long, piece int, length long")
    rows = pack(pieces, block=500).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    least = -(-sum(fill.values()) // 4096)
    assert len(rows) == 6000 and max(fill.values()) <= 4096 and len(fill) <= least * 1.01 + 1


def test_equal_pieces_and_repeated_rows(spark):
    pieces = spark.createDataFrame([(None if i % 2 else 5, 0, 2049) for i in range(500)], "doc_id long, piece int, length long")
    rows = pack(pieces, block=100).collect()
    assert len({r.sequence_id for r in rows}) == 500 and all(r.offset == 0 for r in rows)
    assert pack(pieces.limit(0)).count() == 0


def test_sequences_hold_their_ids(spark, library):
    texts = [(i, f"text number {i} " * (i % 9)) for i in range(60)]
    packed = pack(cut_pieces(spark.createDataFrame(texts, "doc_id long, text string"), PATH, capacity=50, ids=True), 50)
    placed = {(r.sequence_id, r.offset): r for r in packed.collect()}
    made = {r.sequence_id: r for r in sequences(packed).collect()}
    for (number, offset), r in placed.items():
        ids = [*library.encode(dict(texts)[r.doc_id], add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert list(made[number].ids[offset : offset + r.length]) == ids
    assert sum(r.length for r in made.values()) == sum(r.length for r in placed.values())
