"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import pii, quality

_WORD = r"[^\x20\x09-\x0D]+"


def jaccard_sql(percent: int = 75) -> str:
    """All pairs that share a shingle, counted; components by closure."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= {percent} * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


def quality_sql() -> str:
    """Measures, host rates shrunk by a moment-fitted beta prior, verdicts."""
    least, most = quality.WORD_LENGTH
    rules = {
        "few_words": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": f"n_symbols > {quality.SYMBOL_SHARE}::DOUBLE * n_words",
        "dup_lines": f"n_dup_lines > {quality.DUP_LINE_SHARE}::DOUBLE * n_lines", "word_length": f"(word_chars < {least} * n_words OR word_chars > {most} * n_words)",
    }
    counts = ", ".join(f"sum(({c})::INT)::DOUBLE AS k_{r}" for r, c in rules.items())
    sums = ", ".join(f"sum(k_{r}) / sum(n) AS m_{r}, var_pop(k_{r} / n) AS v_{r}" for r in rules)
    inner = lambda r: f"m_{r} * (1 - m_{r})"
    strengths = ", ".join(f"least(greatest({inner(r)} / greatest(v_{r} - {inner(r)} * inverse / hosts, 1e-12) - 1, {quality.LEAST_STRENGTH}), 1e6) AS s_{r}, m_{r}" for r in rules)
    rates = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) AS rate_{r}, m_{r}, n + s_{r} + 1 AS w_{r}" for r in rules)
    good = " AND ".join(f"rate_{r} < {quality.THRESHOLDS[r]}" for r in rules)
    flags = ", ".join(f"CASE WHEN rate_{r} > 0 AND rate_{r} - {quality.EXCESS}::DOUBLE * m_{r} >= {quality.QUANTILE}::DOUBLE * sqrt(rate_{r} * (1 - rate_{r}) / w_{r}) THEN '{r}' END" for r in rules)
    base, failed = f"({rules['few_words']} OR {rules['repeats']})", "(" + " OR ".join(rules.values()) + ")"
    return rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM i),
q AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words, coalesce(l.lines, 0)::BIGINT AS n_lines FROM d LEFT JOIN q USING (doc_id) LEFT JOIN l USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE AS n, {counts} FROM m WHERE source IS NOT NULL GROUP BY source),
z AS (SELECT count(*) AS hosts, sum(1 / n) AS inverse, {sums} FROM h), p AS (SELECT {strengths} FROM z),
r AS (SELECT source, {rates} FROM h, p), v AS (SELECT source, {good} AS ok, concat_ws(',', {flags}) AS flags, {', '.join(f'round(rate_{r}, 9) AS rate_{r}' for r in rules)} FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, {base} AS base_failed, {failed} AS rule_failed, coalesce(ok, TRUE) AS host_ok, coalesce(flags, '') AS host_flags, {', '.join(f'rate_{r}' for r in rules)},
  NOT {base} AND coalesce(ok, TRUE) AND NOT ({failed} AND coalesce(flags, '') <> '') AS kept FROM m LEFT JOIN v USING (source)"""


def pii_sql() -> str:
    """Base spans by the gaps between matches, and the terms of their documents that disclose an entity, by class."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"(SELECT sum(CASE WHEN j % 2 = 1 THEN CASE WHEN c > 4 THEN 2 * c - 9 ELSE 2 * c END ELSE c END) % 10 = 0 FROM (SELECT unnest(range(length(g))) AS j, unnest(list_transform(range(length(g)), lambda j: substr(g, length(g) - j, 1)::INT)) AS c FROM (SELECT {digits} AS g)))"
    valid = {"email": "TRUE", "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) < 4 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))", "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 10 AND 15"}

    def spans(rows: str, key: str, text: str, pattern: str) -> str:
        """(key, start, v) of all matches of a pattern."""
        return f"""(SELECT {key}, sum(length(g) + length(v)) OVER (PARTITION BY {key} ORDER BY o) - length(v) AS start, v FROM (
  SELECT {key}, unnest(range(len(vs))) AS o, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS vs, string_split_regex({text}, '{pattern}') AS gs FROM {rows}) WHERE len(vs) > 0))"""

    base = " UNION ALL ".join(f"SELECT doc_id, start, {k} AS kind, start + length(v) AS stop, v FROM {spans('d', 'doc_id', 't', p)} WHERE {valid[name]}" for k, (name, p) in enumerate(patterns.items()))
    word = r"\p{L}{3,}"
    named = lambda alias: "['email', 'ip', 'card', 'phone', 'term'][" + alias + ".kind + 1]"
    listed = lambda alias: f"coalesce(string_agg({named(alias)} || ':' || {alias}.start::BIGINT || ':' || {alias}.stop::BIGINT, ',' ORDER BY {alias}.start, {alias}.kind, {alias}.stop), '')"
    wide, wider = (f"CASE WHEN length(term) > {n} THEN substr(term, 1, {n}) || '*' END" for n in pii.CLASSES)
    a, b, c = (f"'{v}'" for v in pii.VERDICTS)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS ({base}),
en AS (SELECT DISTINCT doc_id, kind || ':' || lower(v) AS entity FROM b), e AS (SELECT entity, count(*)::DOUBLE AS df_entity FROM en GROUP BY entity),
f AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM b)),
o AS (SELECT doc_id, lower(x.v) AS term, x.start::BIGINT AS start, (x.start + length(x.v))::BIGINT AS stop FROM {spans('f', 'doc_id', 't', word)} x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.start < x.start + length(x.v) AND b.stop > x.start)),
g AS (SELECT DISTINCT doc_id, term, {wide} AS wide, {wider} AS wider FROM o),
i AS (SELECT doc_id, term AS item FROM g UNION SELECT doc_id, wide FROM g WHERE wide IS NOT NULL UNION SELECT doc_id, wider FROM g WHERE wider IS NOT NULL),
v AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(t), '{word}'))) AS term FROM d)),
k AS (SELECT item, count(DISTINCT doc_id)::DOUBLE AS df FROM (SELECT doc_id, term AS item FROM v UNION ALL SELECT doc_id, {wide} FROM v UNION ALL SELECT doc_id, {wider} FROM v) WHERE item IS NOT NULL GROUP BY item),
m AS (SELECT entity, item, count(*)::DOUBLE AS met FROM en JOIN i USING (doc_id) GROUP BY ALL),
z AS (SELECT entity, item FROM m JOIN e USING (entity) JOIN k USING (item), (SELECT greatest(count(*), 2)::DOUBLE AS n FROM d)
  WHERE df_entity < n AND ln((met + df / n) / (df_entity + 1) / (df / n)) / ln(n / df_entity) >= {pii.THRESHOLD}),
x AS (SELECT DISTINCT doc_id, item FROM i JOIN en USING (doc_id) JOIN z USING (entity, item)),
j AS (SELECT g.doc_id, g.term, CASE WHEN wide IS NOT NULL AND x1.item IS NULL THEN {a} WHEN wider IS NOT NULL AND x2.item IS NULL THEN {b} ELSE {c} END AS verdict FROM g JOIN x x0 ON x0.doc_id = g.doc_id AND x0.item = g.term
  LEFT JOIN x x1 ON x1.doc_id = g.doc_id AND x1.item = g.wide LEFT JOIN x x2 ON x2.doc_id = g.doc_id AND x2.item = g.wider),
y AS (SELECT doc_id, start, 4 AS kind, stop, verdict FROM o JOIN j USING (doc_id, term)),
u AS (SELECT doc_id, start, kind, stop FROM b UNION ALL SELECT doc_id, start, kind, stop FROM y),
bs AS (SELECT doc_id, {listed('b')} AS base, {', '.join(f'count(*) FILTER (kind = {i}) AS n{i}' for i in range(4))} FROM b GROUP BY doc_id),
us AS (SELECT doc_id, {listed('u')} AS spans FROM u GROUP BY doc_id),
ys AS (SELECT doc_id, count(*) AS n4, count(*) FILTER (verdict = {c}) AS n5, string_agg(start || ':' || stop || ':' || verdict, ',' ORDER BY start) AS terms FROM y GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n{i}, 0) AS n_{k}' for i, k in enumerate(pii.KINDS))}, coalesce(n5, 0) AS n_removed, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(terms, '') AS terms
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN us USING (doc_id) LEFT JOIN ys USING (doc_id)"""


def negatives_sql() -> str:
    """All products of anchors and rows; positives, then the window of each."""
    fine = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE)))"
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {fine}),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT g.anchor_id, g.id AS positive_id, (row_number() OVER w)::INT AS rank, n.id AS negative_id, g.score AS positive_score, n.score AS negative_score
FROM g JOIN p n ON n.anchor_id = g.anchor_id AND NOT n.same AND 80 * g.score <= 100 * n.score AND 100 * n.score <= 100 * g.score
WINDOW w AS (PARTITION BY g.anchor_id, g.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5"""


def resample_sql(buckets: int = 10_000) -> str:
    """CRC-32 by bytes over the distinct features; totals, gains, weights and the draw."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    crc = "xor(4294967295, list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"
    head = "(('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE"
    return f"""WITH k AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i))),
d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents), x AS MATERIALIZED (SELECT doc_id, unnest({runs}) AS f FROM d),
y AS (SELECT unnest({runs}) AS f FROM (SELECT {words} AS w FROM benchmark)),
c AS MATERIALIZED (SELECT f, {crc} % {buckets} AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM x UNION ALL SELECT f FROM y)), k),
s AS (SELECT b, count(*) AS n FROM x JOIN c USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM y JOIN c USING (f) GROUP BY b),
g AS MATERIALIZED (SELECT z.b, floor(1000::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM range({buckets}) z(b) LEFT JOIN s ON s.b = z.b LEFT JOIN t ON t.b = z.b),
u AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN c USING (f) JOIN g USING (b) GROUP BY doc_id),
v AS (SELECT d.doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln({head})))::BIGINT AS score FROM d LEFT JOIN u USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v WHERE words >= 20)
SELECT v.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank FROM v LEFT JOIN r USING (doc_id)"""


def statements() -> dict[str, str]:
    """SQL by name of query."""
    return {"op2_pii": pii_sql(), "op3_ngram_jaccard": jaccard_sql(), "op9_quality_rules": quality_sql(), "op12_hard_negatives": negatives_sql(), "op13_importance_resampling": resample_sql()}
