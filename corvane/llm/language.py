"""Language identification with interpolated Kneser-Ney character models.

For each language a model of character sequences of up to ORDER characters, inside words with a space on either side, is
kept in hash arrays: sorted 64-bit hashes of sequences with the discounted share of the last character, and sorted hashes
of contexts with the weight of the next lower order, a column for each language. A document gets the language of lowest
cross-entropy per character. A document is rejected when even that lies beyond what held-back documents of the language
show; the score is a posterior whose sharpness is fitted to the same documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, release, where_text

ORDER = 4
UNKNOWN = "und"
#: Bounds of the fitted sample: bytes of text for each language, and of one text.
SAMPLE_BYTES = 4_000_000
LONGEST_TEXT = 200_000
#: Every fifth sampled document is held back from counting, for calibration.
HELD_BACK = 5
LEAST_CALIBRATION = 5
MEMO_WORDS, STEP_WORDS = 150_000, 4_096
_WORDS = re.compile(r"[^\W\d_]+")
_K = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _letters(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hash of the k characters that end at each place, for k = 0..order; place in its word; word number)."""
    joined = "".join([" " + w + " " for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    number = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[number]
    raw = np.zeros(len(codes), np.uint64)
    out = [np.zeros(len(codes), np.uint64)]
    for k in range(1, order + 1):
        # Sequences that begin further left have their first character added with a higher power.
        power = _K ** np.uint64(k - 1)
        raw = raw.copy()
        raw[k - 1 :] += codes[: len(codes) - k + 1] * power
        h = raw + np.uint64(k)
        h = (h ^ (h >> np.uint64(31))) * _MIX
        out.append(h ^ (h >> np.uint64(29)))
    return out, place, number


@dataclass
class HashArray:
    """Sorted hashes with a row of values each, and a row for all others."""

    keys: np.ndarray
    rows: np.ndarray  # one more row than keys: the last is for hashes that are not there

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.repeat(self.rows[-1:], len(hashes), axis=0)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.rows[np.where(self.keys[at] == hashes, at, len(self.keys))]


@dataclass
class Model:
    """Character models of all languages, with calibration."""

    languages: list[str]
    order: int
    shares: list[HashArray]
    weights: list[HashArray]
    base: float
    limits: np.ndarray
    slack: np.ndarray
    sharpness: float

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log2 probability of each word in each language, characters predicted)."""
        n = len(self.languages)
        if not words:
            return np.zeros((0, n)), np.zeros(0, np.int64)
        hashes, place, number = _hashes(words, self.order)
        at = np.flatnonzero(place > 0)
        p = np.full((len(at), n), self.base)
        for k in range(1, self.order + 1):
            fits = np.flatnonzero(place[at] >= k - 1)
            spot = at[fits]
            context = hashes[k - 1][spot - 1] if k > 1 else np.zeros(len(spot), np.uint64)
            p[fits] = self.shares[k].find(hashes[k][spot]) + self.weights[k].find(context) * p[fits]
        logs = np.log2(p)
        out = np.zeros((len(words), n))
        for j in range(n):
            out[:, j] = np.bincount(number[at], logs[:, j], minlength=len(words))
        return out, np.bincount(number[at], minlength=len(words))

    def judge(self, entropy: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its posterior, whether it is rejected) from cross-entropies per character."""
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        share = np.exp(-self.sharpness * (entropy - low[:, None]))
        rejected = low > self.limits[best] + self.slack[best] / np.sqrt(np.maximum(chars, 1))
        return best, 1 / share.sum(axis=1), rejected


def _counts(counts: Counter, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each k: (hashes of k characters, their contexts' hashes, Kneser-Ney counts)."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], float)
    hashes, place, number = _hashes(words, order)
    weight = weight[number]
    out = []
    for k in range(1, order + 1):
        # Places where the k characters lie inside a word's frame and end with a predicted character.
        full = np.flatnonzero((place >= k - 1) & (place > 0))
        keys, first, inverse = np.unique(hashes[k][full], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight[full], minlength=len(keys))
        if k < order:
            # Lower orders count the different characters before; at the start of a word nothing can stand before.
            longer = np.flatnonzero((place >= k) & (place > 0))
            _, one = np.unique(hashes[k + 1][longer], return_index=True)
            slot = np.searchsorted(keys, hashes[k][longer[one]])
            varied = np.bincount(slot, minlength=len(keys)).astype(float)
            starts = place[full[first]] == k - 1
            count = np.where(starts, count, np.maximum(varied, 1))
        spot = full[first]
        contexts = hashes[k - 1][spot - 1] if k > 1 else np.zeros(len(spot), np.uint64)
        out.append((keys, contexts, count))
    return out


def train(samples: dict[str, Counter], order: int = ORDER) -> Model:
    """Fit models to word counts by language; calibration is set apart and neutral here."""
    languages = sorted(samples)
    tables = {x: _counts(samples[x], order) for x in languages if samples[x]}
    shares, weights = [HashArray(np.zeros(0, np.uint64), np.zeros((1, len(languages))))], [HashArray(np.zeros(0, np.uint64), np.ones((1, len(languages))))]
    alphabet = len(set().union(*[set("".join(c)) for c in samples.values()])) + 2 if samples else 2
    for k in range(1, order + 1):
        keys = np.unique(np.concatenate([t[k - 1][0] for t in tables.values()])) if tables else np.zeros(0, np.uint64)
        heads = np.unique(np.concatenate([t[k - 1][1] for t in tables.values()])) if tables else np.zeros(0, np.uint64)
        share, weight = np.zeros((len(keys) + 1, len(languages))), np.ones((len(heads) + 1, len(languages)))
        for j, x in enumerate(languages):
            if x not in tables:
                continue
            own, contexts, count = tables[x][k - 1]
            one, two = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
            discount = one / (one + 2 * two) if one and two else 0.5
            head, inverse = np.unique(contexts, return_inverse=True)
            total = np.bincount(inverse, count)
            kept = np.maximum(count - discount, 0)
            share[np.searchsorted(keys, own), j] = kept / total[inverse]
            weight[np.searchsorted(heads, head), j] = np.maximum(1 - np.bincount(inverse, kept) / total, 1e-9)
        shares.append(HashArray(keys, share))
        weights.append(HashArray(heads, weight))
    n = len(languages)
    return Model(languages, order, shares, weights, 1 / alphabet, np.full(n, np.inf), np.zeros(n), 1.0)


class Scorer:
    """Cross-entropies of texts, with a memo of words of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.model.languages)))
        self.chars = np.zeros(1024, np.int64)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by language, characters predicted); no characters: zeros."""
        split = [_letters(t) for t in texts]
        if len(self.number) > MEMO_WORDS:
            self.clear()
        new = sorted(set().union(*split).difference(self.number)) if split else []
        if new:
            parts = [self.model.words(new[i : i + STEP_WORDS]) for i in range(0, len(new), STEP_WORDS)]
            logs, chars = (np.concatenate(x) for x in zip(*parts, strict=True))
            lettered = np.array([any(map(str.isalpha, w)) for w in new])
            logs[~lettered], chars[~lettered] = 0, 0
            at = len(self.number)
            while at + len(new) > len(self.chars):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
                self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
            self.logs[at : at + len(new)], self.chars[at : at + len(new)] = logs, chars
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
        entropy, total = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        for i, words in enumerate(split):
            ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            total[i] = self.chars[ids].sum()
            if total[i]:
                entropy[i] = -self.logs[ids].sum(axis=0) / total[i]
        return entropy, total


def calibrate(model: Model, texts: list[tuple[str, str]]) -> Model:
    """Fit limits and sharpness to held-back (language, text) pairs.

    A language's limit is the 99.9th percentile of its documents' cross-entropies plus three deviations, with a slack
    that shrinks with the square root of the length, from the widest deviation seen. A language with fewer than
    LEAST_CALIBRATION held-back documents takes the widest limits of the others; where all have fewer, none rejects.
    """
    if not model.languages or not texts:
        return model
    entropy, chars = Scorer(model).entropies([t for _, t in texts])
    truth = np.array([model.languages.index(x) for x, _ in texts])
    some = chars > 0
    for j in range(len(model.languages)):
        own, n = entropy[some & (truth == j), j], chars[some & (truth == j)]
        if len(own) >= LEAST_CALIBRATION:
            middle = np.average(own, weights=n)
            model.limits[j] = np.quantile(own, 0.999) + 3 * own.std()
            model.slack[j] = max(0.0, ((own - middle) * np.sqrt(n)).max())
    fitted = np.isfinite(model.limits)
    if fitted.any():
        model.limits[~fitted], model.slack[~fitted] = model.limits[fitted].max(), model.slack[fitted].max()
    gaps = entropy[some] - entropy[some].min(axis=1, keepdims=True)
    target = truth[some]
    best = (np.inf, 1.0)
    for sharpness in (0.5, 1, 2, 4, 8, 16, 32):
        z = -sharpness * gaps
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target])) if len(z) else 0.0
        best = min(best, (loss, float(sharpness)))
    model.sharpness = best[1]
    return model


def fit(docs: DataFrame, usable: Column, label: str = "lang", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train and calibrate on a bounded sample of the usable labelled rows.

    The sample holds about ``sample_bytes`` of text for each language, drawn by a hash of id and text at a rate that a
    count over all usable rows gives; longer texts than LONGEST_TEXT bytes are not drawn. It is the only thing that
    reaches the driver.
    """
    rows = docs.where(usable & F.col(label).isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST_TEXT))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.sum(F.octet_length("text"))).collect()}
    if not sizes:
        return train({}, order)
    rate = F.lit(0.0)
    for x, size in sizes.items():
        rate = F.when(F.col(label) == x, F.lit(min(1.0, sample_bytes / max(size, 1)))).otherwise(rate)
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1_000_000)) / 1e6 < rate
    part = F.pmod(F.xxhash64(F.lit(12), "doc_id", "text"), F.lit(HELD_BACK))
    sample = rows.where(drawn).select(F.col(label).alias("x"), "text", part.alias("part")).toArrow()
    counts: dict[str, Counter] = {x: Counter() for x in sizes}
    back: list[tuple[str, str]] = []
    for x, text, p in zip(*[c.to_pylist() for c in sample.columns], strict=True):
        if p == 0:
            back.append((x, text))
        else:
            counts[x].update(w for w in _letters(text) if any(map(str.isalpha, w)))
    return calibrate(train(counts, order), back)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict each row's language from its ``text`` alone.

    Adds lang_pred, score (0 to 1), entropy (bits per character) and rejected. A null text, one without letters, or a
    model without languages gives ``und``, score 0, and is rejected; equal texts get equal values; repeated rows stay
    repeated; an empty table gives an empty result; columns other than ``keep`` are ignored. The model is broadcast: its
    size is bounded by the sample. No shuffle; a worker's memo of words is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        release()
        scorer = Scorer(shared.value)

        def work(texts: list[bytes]) -> dict[str, list]:
            m = scorer.model
            if not m.languages:
                n = len(texts)
                return {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "entropy": [0.0] * n, "rejected": [True] * n}
            entropy, chars = scorer.entropies([t.decode(errors="replace") for t in texts])
            best, score, rejected = m.judge(entropy, chars)
            none = chars == 0
            return {
                "lang_pred": [UNKNOWN if z else m.languages[j] for j, z in zip(best, none, strict=True)],
                "score": np.where(none, 0.0, score),
                "entropy": entropy[np.arange(len(best)), best],
                "rejected": rejected | none,
            }

        return work

    fields = [("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())]
    return per_text(docs, list(keep), make, fields, "lang_pred string, score double, entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all columns, whatever their names, that the model does not reject; without languages in the model, all rows.

    Null and empty texts, and those without a letter, are rejected; equal texts fare alike, so repeated rows stay or go
    together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        release()
        scorer = Scorer(shared.value)

        def work(texts: list[bytes]) -> list[bool]:
            if not scorer.model.languages:
                return [True] * len(texts)
            entropy, chars = scorer.entropies([t.decode(errors="replace") for t in texts])
            return list(~scorer.model.judge(entropy, chars)[2] & (chars > 0))

        return work

    return where_text(docs, make)
