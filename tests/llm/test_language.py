"""Language models: probabilities sum to one, held-out accuracy, rejection, edges."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import language as L
from corvane.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"


def plain(counts, order, word, base):
    """Interpolated Kneser-Ney of a framed word, from the definition."""
    grams = [Counter() for _ in range(order + 1)]
    for w, n in counts.items():
        framed = f" {w} "
        for end in range(1, len(framed)):
            for k in range(1, order + 1):
                if end - k + 1 >= 0:
                    grams[k][framed[end - k + 1 : end + 1]] += n
    use = [None] * (order + 1)
    use[order] = grams[order]
    for k in range(1, order):
        before = Counter(g[1:] for g in grams[k + 1])
        use[k] = Counter({g: n if g.startswith(" ") and len(g) == k and k > 1 or (k == 1 and False) else max(before[g], 1) for g, n in grams[k].items()})
    total = 0.0
    framed = f" {word} "
    for end in range(1, len(framed)):
        p = base
        for k in range(1, order + 1):
            if end - k + 1 < 0:
                continue
            gram = framed[end - k + 1 : end + 1]
            head = {g: n for g, n in use[k].items() if g[:-1] == gram[:-1]}
            if not head:
                continue
            one, two = sum(v == 1 for v in use[k].values()), sum(v == 2 for v in use[k].values())
            d = one / (one + 2 * two) if one and two else 0.5
            size = sum(head.values())
            weight = max(1 - sum(max(n - d, 0) for n in head.values()) / size, 1e-9)
            p = max(head.get(gram, 0) - d, 0) / size + weight * p
        total += math.log2(p)
    return total


def test_probabilities_from_the_definition():
    counts = Counter({"the": 7, "then": 3, "hen": 2, "het": 1, "tt": 1, "nth": 2})
    model = L.train({"x": counts}, 3)
    for word in ("the", "hen", "zebra", "t"):
        assert abs(model.words([word])[0][0, 0] - plain(counts, 3, word, model.base)) < 1e-9
    assert model.words(["the"])[1][0] == 4


def test_hash_arrays_are_sorted():
    model = L.train({"x": Counter("some words to count".split()), "y": Counter("andere wörter".split())}, 3)
    for a in model.shares + model.weights:
        assert (np.diff(a.keys.astype(object)) > 0).all() if len(a.keys) > 1 else True
        assert len(a.rows) == len(a.keys) + 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = L.fit(docs, ~held_out("doc_id", 3))
    got = L.predict(docs, model).join(docs.select("doc_id", "lang", held_out("doc_id", 3).alias("out")), "doc_id").where("out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.99
    assert np.mean([r.rejected for r in got]) < 0.01 and all(0 <= r.score <= 1 for r in got)
    strange = spark.createDataFrame([(1, "zzqx jjkw qqq xkcd wqpz " * 20), (2, "это русский текст " * 20), (3, "漢字" * 50)], "doc_id long, text string")
    assert all(r.rejected for r in L.predict(strange, model).collect()) and L.accepted(strange, model).count() == 0


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs, F.lit(True))
    changed = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("??").alias("lang"), F.lit("s").alias("source"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    b = {r.doc_id - 7: (r.lang_pred, r.score) for r in L.predict(changed, model).collect()}
    assert a == b


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !! ½ _", "de"), (4, "words of a text " * 200, "en"), (4, "words of a text " * 200, "en"), (5, "wörter und mehr " * 200, "de"), (None, "words", None), (6, "a" * 300_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = L.fit(docs, F.lit(True))
    got = sorted(((str(r.doc_id), r.lang_pred, r.score) for r in L.predict(docs, model).collect()))
    assert len(got) == 8 and [x[1:] for x in got if x[0] in "123"] == [("und", 0.0)] * 3
    assert {x[1] for x in got if x[0] == "4"} == {"en"} and {x[1] for x in got if x[0] == "5"} == {"de"}
    none = L.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in L.predict(docs, none).collect()} == {"und"} and L.predict(docs.limit(0), model).count() == 0
    assert L.accepted(docs, none).count() == 8
    assert not spark.createDataFrame([(None,)], "doc_id long").select(held_out("doc_id", 3)).first()[0]
