"""What workers keep from one operator to the next."""

from collections import Counter

import numpy as np
from corvane.llm import language, pieces
from corvane.llm.queries import model_path


def test_a_worker_keeps_one_operator(spark, monkeypatch):
    """An encoder stays for the next task of its operator, and goes once the worker runs another one."""
    coder = pieces.coder_of(model_path())
    assert pieces.coder_of(model_path()) is coder
    monkeypatch.setattr(language, "where_text", lambda docs, make: make)
    language.accepted(spark.range(1), language.train({"en": Counter(["door"])}))()
    assert pieces.coder_of(model_path()) is not coder


def test_small_memos_change_nothing():
    text = "the door of the house, la maison 12 " * 50
    assert pieces.MergeCoder(model_path(), 3).encode_text(text) == pieces.MergeCoder(model_path()).encode_text(text)


def test_words_in_steps(monkeypatch):
    model = language.train({"en": Counter({"door": 3, "house": 2}), "fr": Counter({"maison": 2})})
    whole = language.Scorer(model).entropies(["door house maison la", "xyz"])
    monkeypatch.setattr(language, "STEP_WORDS", 2)
    parts = language.Scorer(model).entropies(["door house maison la", "xyz"])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
