"""The pipeline stage by stage against plain Python."""

from __future__ import annotations

import collections

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from corvane.llm.queries import model_path

from .test_jaccard import brute
from .test_pii import base

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    strange = spark.createDataFrame([(-1, "zzqx jjkw qqq xkcd wqpz " * 30, None, "src1", 720), (-2, None, None, None, None)], docs.schema)
    docs = docs.unionByName(strange)
    assert [n for n, _ in P.STAGES] == ["language identification", "n-gram jaccard join", "personal data", "mixing sources", "piece encoding"]
    stages, out = [f for _, f in P.STAGES], []
    for k, stage in enumerate(stages):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    kept, unique, clean, mixed, coded = out
    assert not {-1, -2} & {r.doc_id for r in kept} and len(kept) >= 199
    assert {r.doc_id for r in unique} == {c for _, _, c in brute([(r.doc_id, r.text) for r in kept])} and len(unique) < len(kept)
    before = {r.doc_id: r.text for r in unique}
    assert {r.doc_id for r in clean} == set(before)
    for r in clean:
        assert r.text == before[r.doc_id] if not base(before[r.doc_id]) else not base(r.text)
        assert r.n_chars == len(r.text)
    after = {r.doc_id: r.text for r in clean}
    counts = collections.Counter(r.doc_id for r in mixed)
    assert max(counts.values()) <= 3 and all(r.text == after[r.doc_id] for r in mixed)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(mixed) - words(clean)) < 0.1 * words(clean)
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert collections.Counter(r.doc_id for r in coded) == counts
    for r in coded:
        assert list(r.ids) == library.encode(after[r.doc_id], add_eos=True)


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    """All stages carry columns of any name along, and take nulls and repeated rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, "Elle un la que de les et des.", "fr", None, 29), (-3, "", None, None, 0)], docs.schema))
    clash = ["text_", "score", "__all", "__n", "__row", "__key", "__file", "__at", "copies", "size", "n_tokens", "doc id"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("n_chars").cast("string")) for c in clash})
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        got = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert got.columns == docs.columns and got.count() > 20
            assert got.where(" OR ".join(f"`{c}` NOT LIKE '{c}%'" for c in clash)).count() == 0
            docs = got
    assert got.count() == docs.count()


def test_run_and_empty(spark):
    from pathlib import Path

    from corvane.llm.common import discard, filed, shared_folder

    copies = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).rglob("rows-*")}
    before = copies()
    assert P.run(spark, FOLDER).count() > 150
    assert len(copies() - before) <= 3  # what the last stage reads, and the last labels of both groupings
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert not discard(source) and not discard(source.limit(3)) and Path(f"{FOLDER}/documents.parquet").exists()
    now = copies()
    assert discard(filed(source.limit(3))) and copies() == now
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).withColumn("extra", F.lit(1))
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
