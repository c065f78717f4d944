"""What the gram index moves as tables grow."""

from corvane.operators import grams


def test_grams_are_rows_by_segment(spark, tmp_path, monkeypatch):
    """A gram is one row for each segment of files; long alphabets, surrogates and texts at a segment's edge are right."""
    texts = [(i, "abcabc" + chr(0x4E00 + i) + "é😀") for i in range(50)] + [(50, None), (51, "ab"), (52, "z" * 300)]
    files = spark.createDataFrame(texts, "file long, text string").coalesce(1)
    want = sorted((t[i : i + 3], f) for f, t in texts if t for i in range(len(t) - 2))
    assert sorted(map(tuple, grams.file_grams(files).collect())) == sorted(set(want))
    monkeypatch.setattr(grams, "PIECE", 100)
    index = grams.GramIndex.write(files, str(tmp_path))
    assert index.grams.where("gram = 'abc'").count() < 50 and index.grams.groupBy("gram", "segment").count().where("count > 1").count() == 0
    assert sorted(r.file for r in index.candidates("bcab").collect()) == list(range(50)) and [r.file for r in index.candidates(chr(0x4E05) + "é😀").collect()] == [5]


def test_grams_of_many_signs():
    """Grams are right where codes of three signs and a text's number exceed 63 bits."""
    text = "".join(chr(i) for i in range(0x100, 0x10FFFF, 3) if not 0xD7FD <= i <= 0xDFFF)
    found, starts, of = grams._inverted([text, text[:50]] + ["x"] * 2000)
    assert found == sorted(text[i : i + 3] for i in range(len(text) - 2)) and len(of) == len(found) + 48 and starts[1] == 2
