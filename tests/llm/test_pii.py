"""Personal data against plain Python: patterns, statistics and rewriting."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm.pii import pii_spans, sanitise

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    None, "", "plain words only", "a@b.c_d@e.fg", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "+1 (234) 567-8901 é😀 a@b.co 4111 1111 1111 1111x4111111111111111",
    "a" * 50_000, "1" * 3000, "é " * 300 + "x@y.zz " * 2500, "+1" * 500, "....1.1.1.1", "1.1.1.1@a.b 12@1.1", "no. 4111-1111-1111-1111, call +49 30 1234567.", "a@b a@b. .@x.y",
    "10.0.0.1 0.0.0.0 000.0.00.1 300.1.1.1 1.256.1.1 0255.0.0.00001",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


def base(text):
    out = []
    for k, (name, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def written(spans):
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)


def test_base_spans(spark):
    rows = list(enumerate(TEXTS)) + [(99, TEXTS[5]), (99, TEXTS[5]), (None, "x@y.z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii_spans(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        spans = base(t or "")
        n = collections.Counter(s[3] for s in spans)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written(spans).encode()).hexdigest(), written(spans)] += 1
    assert got == want
    assert pii_spans(docs.limit(0)).count() == 0 and sanitise(docs.limit(0)).count() == 0


def disclosure_corpus():
    rows = [(i, f"Some unlike words number {'abcdefghij'[i % 10] * 4} stand around zebrafish and write ann@corp.example today {'xyz' * (i % 3)} again.") for i in range(6)]
    rows += [(100 + i, f"Other words {'qrstuv'[i % 6] * 5} without any data but today and again and around and some words.") for i in range(60)]
    rows += [(200, "Nothing of zebrafish here.")]
    return rows


def brute(rows, at=0.85):
    """Of each row: (start, 4, end, 'term') with verdict, and the rewritten text, by the definitions in plain Python."""
    n, df, entity, pairs, words = len(rows), collections.Counter(), collections.Counter(), collections.Counter(), {}
    classes = lambda w: [w[:k] + "*" if len(w) > k else None for k in (4, 2)]
    items = lambda ws: {x for w in ws for x in (w, *classes(w)) if x}
    for i, t in rows:
        df.update(items(re.findall(r"[^\W\d_]{3,}", t.lower())))
        spans = base(t)
        free = [m for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(x < m.end() and y > m.start() for x, _, y, _ in spans)]
        words[i] = ({(k, t[a:b].lower()) for a, k, b, _ in spans}, free, spans)
        entity.update(words[i][0])
        pairs.update({(e, w) for e in words[i][0] for w in items(m[0].lower() for m in free)})
    marked, text = {}, {}
    for i, t in rows:
        entities, free, spans = words[i]

        def discloses(w, entities=entities):
            p = df[w] / n
            return any(math.log((pairs[e, w] + p) / (entity[e] + 1) / p) / math.log(n / entity[e]) >= at for e in entities if entity[e] < n)

        marked[i] = []
        for m in free:
            word = m[0].lower()
            if discloses(word):
                level = next((k for k, c in enumerate(classes(word)) if c and not discloses(c)), 2)
                marked[i].append((m.start(), m.end(), ("prefix4", "prefix2", "removed")[level], (*classes(word), "")[level]))
        done, new = 0, ""
        for a, b, label in sorted([(a, b, f"<{k.upper()}>") for a, _, b, k in spans] + [(a, b, label) for a, b, _, label in marked[i]]):
            new, done = new + t[done:a] + label, b
        text[i] = new + t[done:]
    return marked, text


def check_corpus(spark, rows):
    marked, text = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii_spans(docs).collect():
        assert r.terms == ",".join(f"{a}:{b}:{v}" for a, b, v, _ in marked[r.doc_id]), r
        assert r.spans == written(sorted(base(dict(rows)[r.doc_id]) + [(a, 4, b, "term") for a, b, _, _ in marked[r.doc_id]])), r
        assert r.n_term == len(marked[r.doc_id]) and r.n_removed == sum(v == "removed" for _, _, v, _ in marked[r.doc_id])
    assert {r.doc_id: r.text for r in sanitise(docs).collect()} == text
    return marked, text


def test_disclosing_terms(spark):
    """A term of one entity goes, at the first level that says less; common words and other documents stay."""
    rows = disclosure_corpus() + [(400 + i, f"The zebras and the zeal of zeppelins {i}.") for i in range(40)] + [(500 + i, f"Some zebracorn number {i}.") for i in range(20)]
    marked, text = check_corpus(spark, rows)
    assert "zebr*" in text[0] and "zebrafish" not in text[0] and "<EMAIL>" in text[0] and "today" in text[0]
    assert all(text[i] == t for i, t in rows if not base(t))
    levels = collections.Counter(v for m in marked.values() for _, _, v, _ in m)
    assert levels["prefix4"] and levels["removed"]


@pytest.mark.parametrize("text", ["+1 234 567 8901 4111 1111 1111 1111 end", "é a@b.co, 10.0.0.1", None, ""])
def test_rewriting(spark, text):
    got = sanitise(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n int")).first()
    if not text:
        assert got.text == text
    else:
        assert not base(got.text) and got.n == 5


def test_no_python_in_the_plan(spark):
    plan = pii_spans(spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_terms_of_an_entity_in_one_text(spark):
    """An entity of one or two texts has terms too; common words stay."""
    rows = disclosure_corpus() + [(300, "Only quokka words stand around bob@corp.example today."), (301, "Some wombat and cy@corp.example again."), (302, "The wombat wrote as cy@corp.example to dee@corp.example again.")]
    rows += [(1000 + i, f"Some common words again and today {i}. " + ("A wolf of note." if i % 3 else "A quote.")) for i in range(300)]
    marked, text = check_corpus(spark, rows)
    assert text[300] == " qu* words stand around <EMAIL> today." and "wombat" not in text[301] + text[302] and "again" in text[301]
    assert {v for _, _, v, _ in marked[300]} == {"prefix2", "removed"}


def test_terms_of_the_whole_document(spark):
    """A term far from the entity, and its second occurrence, are replaced; so are terms of a long list of entities."""
    rows = [(i, f"Some common words again and today {i}.") for i in range(300)]
    rows += [(300, "Quokka words. " + "some common words again and " * 40 + "bob@corp.example today " + "again and " * 90 + "the QUOKKA, quokka.")]
    rows += [(301, " ".join(f"user{i}@corp.example" for i in range(400)) + " numbat again")]
    _, text = check_corpus(spark, rows)
    assert "quokka" not in text[300].lower() and text[300].endswith(" , .") and text[301].endswith("  again")


def test_heavy_keys(spark, monkeypatch):
    """An entity, a term and a text that a third of all rows have; with every key heavy and with none."""
    from corvane.llm import common

    rows = [(i, f"Some common words again {i}.") for i in range(100)] + [(200 + i, "Write to ann@corp.example about the zebrafish again.") for i in range(60)] + [(300 + i, f"The zebrafish {i} of ann@corp.example.") for i in range(20)]
    want = {i: ",".join(f"{a}:{b}:{v}" for a, b, v, _ in m) for i, m in brute(rows)[0].items()}
    for share in (0.0, 1.0):
        monkeypatch.setattr(common, "HEAVY_SHARE", share)
        assert {r.doc_id: r.terms for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_edges(spark):
    """Nulls in any column, names that clash with the operator's own, repeated rows, an entity in every document."""
    rows = [(1, "a@b.co numbat", "x", 1), (1, "a@b.co numbat", "x", 1), (None, "a@b.co numbat", None, None), (2, "a@b.co wombat", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__key` string, `spans` int")
    assert sorted(map(str, sanitise(docs).collect())) == sorted(map(str, spark.createDataFrame([(i, t.replace("a@b.co", "<EMAIL>"), k, n) for i, t, k, n in rows], docs.schema).collect()))
    assert sorted(str(r.doc_id) for r in pii_spans(docs).collect()) == ["1", "1", "2", "None"]
    empty = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert sorted(map(str, sanitise(empty).collect())) == sorted(map(str, empty.collect()))
