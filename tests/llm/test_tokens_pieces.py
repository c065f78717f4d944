"""Token counts and piece encoding against the library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corvane.llm.pieces import MergeCoder, encode_pieces
from corvane.llm.queries import model_path
from corvane.llm.tokens import Resync, token_counts

SIGNS = ["a", "e", "t", " ", "  ", "\n", "é", "▁", "ing", "the", "😀", "漢", "1", "\t", "　", "<s>", "\x00", ".", "zz", "th", "e ", "don't", "--", "0.5"]
LONG = ["a" * 5000, " " * 3000, "=" * 1000 + "-" * 3000, "ab" * 4000, "漢字" * 900, "th" * 1000 + "e" * 999, "word " * 3000]
EDGES = [(1, None), (2, ""), (3, " "), (4, "a\n b"), (4, "a\n b"), (5, "▁x <s> </s>"), (None, "no id"), (6, "lorem ipsum, " * 4000)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def coder():
    return MergeCoder(model_path())


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_encoding_is_the_library_s(library, coder):
    for t in texts(4000, 30, 1) + LONG:
        want = library.encode(t, add_eos=True)
        assert coder.encode(t) == want
        assert coder.decode(want) == library.decode(want)


def test_decoding_of_any_ids(library, coder):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids)


def test_no_merge_of_whole_texts(coder, monkeypatch):
    """Only pieces and pairs of pieces are ever merged."""
    seen = []
    merge = coder.merge
    monkeypatch.setattr(coder, "merge", lambda t: (seen.append(len(t)), merge(t))[1])
    coder.split("▁" + "qwertyuiop" * 50)
    assert max(seen, default=0) <= 32


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (200, 16), (16, 2)])
def test_spliced_chunks_are_the_whole(library, chunk, overlap):
    coder = Resync(model_path(), chunk, overlap)
    for t in texts(1200, 300, chunk) + LONG:
        assert coder.encode(t)[0].tolist() == library.encode(t)
    assert coder.widened > 0 or chunk > 64


def test_spliced_chunks_are_used(library):
    coder = Resync(model_path(), 64, 8)
    ids, chunks = coder.encode("plain words of a text " * 100)
    assert chunks > 10 and ids.tolist() == library.encode("plain words of a text " * 100)


def test_token_counts_of_edges(spark, library):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, model_path(), chunk=512, overlap=32).collect())
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in EDGES)
    assert got == want
    assert token_counts(docs.limit(0), model_path()).count() == 0


def test_pieces_of_edges(spark, library):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_pieces(docs, model_path()).collect())
    want = []
    for i, t in EDGES:
        ids = library.encode(t or "", add_eos=True)
        want.append((str(i), len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert got == sorted(want)
    row = encode_pieces(docs.where("doc_id = 5"), model_path(), texts=True).first()
    assert np.array_equal(row.ids, library.encode(EDGES[5][1], add_eos=True)) and row.decoded == " x <s> </s>"
    assert encode_pieces(docs.limit(0), model_path()).count() == 0


def test_pieces_over_a_unit_s_edge(library, coder):
    """Letters that are not alphabetic, and every piece with a sign after a letter, against the library."""
    texts = ["Area 120 km².", "m²., km². ¼. ½, x³."]
    texts += [t + p.replace("▁", " ") for p in coder.ids if any(a.isalnum() and not b.isalnum() for a, b in zip(p, p[1:], strict=False)) for t in ("", "x", "Area 120 km")]
    assert any("²." in t for t in texts[2:])
    for t in texts:
        assert coder.encode(t) == library.encode(t, add_eos=True), t
    for p in coder.ids:
        assert len(coder.units.findall(p)) == 1, p
