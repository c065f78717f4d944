"""Quality rules against plain Python."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import quality as Q

WS = "[^\x20\x09-\x0d]+"


def plain(text):
    import re

    words = re.findall(WS, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            inside |= set(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a\x0bb\x0cc d e", "x " * 12, "line\nline\n line\nline ", "é😀 " * 20, "#*$%&|<> a", " ".join(f"w{i}" for i in range(9000)) * 2]
    for _ in range(200):
        out.append("".join(rng.choice(["a", "b", "c", "dd", " ", " ", "\n", "*"]) for _ in range(rng.randint(0, 200))))
    return out


def test_measures(spark):
    rows = list(enumerate(texts())) + [(5, texts()[5]), (None, "a b")]
    docs = spark.createDataFrame([(i, t, f"h{(i or 0) % 3}") for i, t in rows], "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.host_rules(docs).collect())
    assert got == collections.Counter((i, *plain(t or "")) for i, t in rows)
    assert Q.host_rules(docs.limit(0)).count() == 0


def verdicts(counts):
    """Empirical beta shrinkage of the rule of too few words, plainly."""
    n, k = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    rates = [c[1] / c[0] for c in counts.values()]
    m = k / n
    mean = sum(rates) / len(rates)
    v = sum((r - mean) ** 2 for r in rates) / len(rates) - m * (1 - m) * sum(1 / c[0] for c in counts.values()) / len(counts)
    strength = min(max(m * (1 - m) / max(v, 1e-12) - 1, 10.0), 1e6)
    return {h: (c[1] + m * strength) / (c[0] + strength) for h, c in counts.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_hosts(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(Q, "BROADCAST_HOSTS", 0)
    long, short = "these are ten different words that make a text good enough", "bad"
    rows = [(i, long if i % 10 else short, "good") for i in range(200)] + [(1000 + i, short if i % 10 else long, "bad") for i in range(200)] + [(2000, short, "new"), (2001, long, None), (2002, short, None)]
    rows += [(3000 + i, long, f"g{i % 8}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {}
    for _, t, h in rows:
        if h is not None:
            n, k = counts.get(h, (0, 0))
            counts[h] = (n + 1, k + (t == short))
    rate = verdicts(counts)
    assert rate["bad"] > Q.THRESHOLDS["few_words"] > rate["new"]
    for r in Q.host_rules(docs, keep=("doc_id", "source")).collect():
        ok = r.source is None or rate[r.source] < Q.THRESHOLDS["few_words"]
        assert r.host_ok == ok and r.kept == (ok and not r.base_failed), r


def rules(text):
    """The five rules in plain Python."""
    import re

    n, chars, symbols, dup, _, base = plain(text)
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    few = n < 10
    return {"few_words": few, "repeats": base and (not few or 100 * plain(text)[4] > 20 * n), "symbols": symbols > 0.1 * n, "dup_lines": dup > 0.3 * len(lines), "word_length": chars < 3 * n or chars > 10 * n}


def judged(rows):
    """(rates, host_ok, flags, kept) of each (id, text, host) row, by the definitions."""
    failed = {i: rules(t or "") for i, t, _ in rows}
    hosts = sorted({h for _, _, h in rows if h is not None})
    rates, flags, ok = {}, {h: [] for h in hosts}, dict.fromkeys(hosts, True)
    for r in Q.THRESHOLDS:
        n = {h: sum(x == h for _, _, x in rows) for h in hosts}
        k = {h: sum(failed[i][r] for i, _, x in rows if x == h) for h in hosts}
        m = sum(k.values()) / sum(n.values())
        share = [k[h] / n[h] for h in hosts]
        mean = sum(share) / len(share)
        v = sum((s - mean) ** 2 for s in share) / len(share) - m * (1 - m) * sum(1 / n[h] for h in hosts) / len(hosts)
        strength = min(max(m * (1 - m) / max(v, 1e-12) - 1, 10.0), 1e6)
        for h in hosts:
            p = rates[h, r] = (k[h] + m * strength) / (n[h] + strength)
            ok[h] = ok[h] and p < Q.THRESHOLDS[r]
            if p > 0 and p - 1.25 * m >= 1.2816 * (p * (1 - p) / (n[h] + strength + 1)) ** 0.5:
                flags[h].append(r)
    out = {}
    for i, _, h in rows:
        f = failed[i]
        base = f["few_words"] or f["repeats"]
        out[i] = (ok.get(h, True), ",".join(flags.get(h, [])), not base and ok.get(h, True) and not (any(f.values()) and bool(flags.get(h))))
    return out, rates


def test_flagged_hosts(spark):
    """A host that fails one rule far more often than the others loses its documents that fail any; clean ones stay."""
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice(["these", "words", "make", "good", "texts"]) + str(rng.randint(0, 9999)) for _ in range(30))
    rows = []
    for i in range(1200):
        host = f"h{i % 12}" if i % 40 else None
        bad = 0.4 if host == "h3" else 0.03
        text = clean()
        if rng.random() < bad:
            text = text.replace(" ", " # ")
        elif rng.random() < 0.03:
            text = "\n".join([text, "again", "again", "again"])
        rows.append((i, text, host))
    want, rates = judged(rows)
    got = {r.doc_id: r for r in Q.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id", "source")).collect()}
    assert {i: (r.host_ok, r.host_flags, r.kept) for i, r in got.items()} == want
    assert {r.host_flags for r in got.values() if r.source == "h3"} == {"symbols"}
    assert any(r.kept != (not r.base_failed) for r in got.values()) and all(r.kept for r in got.values() if not r.rule_failed)
    for r in got.values():
        for rule in Q.THRESHOLDS:
            rate = getattr(r, f"rate_{rule}")
            assert rate is None if r.source is None else abs(rate - rates[r.source, rule]) < 2e-9


def test_hosts_alike(spark):
    """Hosts that differ by chance alone are not flagged: the prior is then as good as certain."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"word{rng.randint(0, 10**6)}" for _ in range(20)) + (" ###" if i % 10 == 0 else ""), f"h{(i // 10) % 5}") for i in range(500)]
    assert {r.host_flags for r in Q.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {""}
