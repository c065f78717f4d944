"""DuckDB SQL for the queries of the catalog."""

from __future__ import annotations

import re

from ..config import STOPWORDS
from ..operators.code import ANNOTATION, CONSTRUCTOR, METHOD, PIECES
from . import literals

TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def _values(rows: list[tuple], columns: str) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns}))"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_DOCS = r"""(SELECT 'd' || doc_id AS chunk_id, 'api' AS source, source || '.' || lang AS fqn, regexp_extract(text, '[A-Z][a-z]{4,}') AS class_name, source AS package, text AS body FROM documents)"""
_ALL = f"""(SELECT chunk_id, source, fqn, class_name, package, body FROM {_DOCS}
  UNION ALL SELECT 'p' || page_id, 'guide', '', NULL, NULL, html FROM pages
  UNION ALL SELECT 'c' || conv_id || '_' || turn, 'mod', 'talk' || conv_id, NULL, NULL, text FROM conversations)"""
_ASKED = _values(literals.QUERIES, "query_id, query")
#: Phrases of queries whose words have one hump each and no dots: words that are no stopwords.
_WORDS = f"""(SELECT query_id, lower(w) AS phrase FROM (SELECT query_id, unnest(regexp_split_to_array(query, '\\s+')) AS w FROM {_ASKED}) WHERE length(w) >= 2 AND lower(w) NOT IN ({_STOP}))"""


def _scores(tag: str, chunks: str, phrases: str) -> str:
    """CTEs up to {tag}_score(query_id, chunk_id, score)."""
    words = TOKENS.format("body")
    return f"""{tag}_c AS (SELECT * FROM {chunks}), {tag}_p AS (SELECT * FROM {phrases}),
{tag}_t AS (SELECT chunk_id, unnest({words}) AS term FROM {tag}_c),
{tag}_l AS (SELECT chunk_id, len({words}) AS length FROM {tag}_c),
{tag}_n AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM {tag}_l),
{tag}_f AS (SELECT chunk_id, term, count(*)::DOUBLE AS f FROM {tag}_t WHERE term IN (SELECT phrase FROM {tag}_p) GROUP BY ALL),
{_weighted(tag)}"""


def _weighted(tag: str) -> str:
    return f"""{tag}_m AS (SELECT term, count(*)::DOUBLE AS matching FROM {tag}_f GROUP BY term),
{tag}_q AS (SELECT query_id, phrase, count(*)::DOUBLE AS times FROM {tag}_p GROUP BY ALL),
{tag}_score AS (SELECT query_id, chunk_id, round(sum(CASE WHEN ln((n - matching + 0.5) / (matching + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - matching + 0.5) / (matching + 0.5)) END
  * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * length / average)) * times), 9) AS score
  FROM {tag}_f JOIN {tag}_m USING (term) JOIN {tag}_l USING (chunk_id) JOIN {tag}_q ON phrase = term, {tag}_n GROUP BY query_id, chunk_id)"""


def _best(tag: str, n: int, where: str = "TRUE") -> str:
    return f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS pos FROM {tag}_score WHERE {where} QUALIFY pos < {n}"


def _fused(tag: str, n: int, where: str = "TRUE") -> str:
    """A keyword ranking alone, fused: {tag}(query_id, chunk_id, rrf_score, pos)."""
    return f"""{tag} AS (SELECT query_id, chunk_id, round(0.3 / (60 + pos), 12) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.3 / (60 + pos), 12) DESC, pos, chunk_id) - 1 AS pos FROM ({_best(tag, 3 * n, where)}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.3 / (60 + pos), 12) DESC, pos, chunk_id) <= {n})"""


_NAMED = f"""named AS (SELECT query_id, t, no FROM (SELECT query_id, list_distinct_ordered AS ts FROM (SELECT query_id, list_filter(regexp_extract_all(query, '\\b[A-Z][a-zA-Z0-9]{{2,}}\\b'), lambda x: length(x) >= 5) AS list_distinct_ordered FROM {_ASKED})), LATERAL (SELECT unnest(ts) AS t, unnest(range(len(ts))) AS no))"""


def _promoted(name: str, first: str, hits: str) -> str:
    """CTE name(query_id, chunk_id, rrf_score, pos): first(query_id, chunk_id, no), then the other hits."""
    return f"""{name} AS (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY part, o, chunk_id) - 1 AS pos FROM (
  SELECT query_id, chunk_id, 1.0 AS rrf_score, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY no, chunk_id) AS o FROM {first}
  UNION ALL SELECT query_id, chunk_id, rrf_score, 1, pos FROM {hits} h WHERE NOT EXISTS (SELECT 1 FROM {first} f WHERE f.query_id = h.query_id AND f.chunk_id = h.chunk_id)))"""


def _boosted(hits: str, chunks: str) -> str:
    """CTE boosted(query_id, chunk_id, rrf_score, pos): overviews of named classes first."""
    return f"""{_NAMED},
first AS (SELECT query_id, chunk_id, min(no) AS no FROM named JOIN {chunks} x ON x.class_name = t AND x.source = 'api' GROUP BY ALL),
{_promoted("boosted", "first", hits)}"""


_COSINE = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _near(n: int, where: str = "TRUE", asked: str = "q.vec_id % 50 = 0") -> str:
    return f"SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 AS pos FROM (SELECT q.vec_id AS query_id, a.vec_id AS chunk_id, round({_COSINE}, 9) AS similarity FROM embeddings a, embeddings q WHERE {asked} AND {where}) QUALIFY pos < {n}"


#: Dense hits of a source: vectors stand for documents and pages; ties go by the text of the id.
_DENSE_N = "(SELECT query_id, mark || chunk_id AS chunk_id, row_number() OVER (PARTITION BY query_id, mark ORDER BY similarity DESC, mark || chunk_id) - 1 AS pos, mark FROM (" + _near(10**9, asked=f"q.vec_id IN (SELECT query_id FROM {_ASKED})") + "), (VALUES ('d'), ('p')) t(mark) QUALIFY pos < 30)"
_DENSE = {"api": f"(SELECT * FROM {_DENSE_N} WHERE mark = 'd')", "guide": f"(SELECT * FROM {_DENSE_N} WHERE mark = 'p')", "mod": f"(SELECT * FROM {_DENSE_N} WHERE FALSE)"}


def _hybrid(tag: str, source: str, n: int) -> str:
    """CTEs up to {tag}(query_id, chunk_id, rrf_score, pos): both rankings of a source, fused; ids without a row go after the cut."""
    rows = f"(SELECT * FROM {_ALL} WHERE source = '{source}')"
    return f"""{_scores(tag, rows, _WORDS)}, {tag}_d AS (SELECT * FROM {_DENSE[source]}),
{tag}_k AS (SELECT * FROM ({_best(tag, 3 * n)}) WHERE query_id IN (SELECT query_id FROM {_ASKED} WHERE regexp_matches(query, '[A-Z._]')) OR query_id NOT IN (SELECT query_id FROM {tag}_d)),
{tag}_b AS (SELECT query_id, chunk_id, d, k, round(coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(0.3::DOUBLE / (60 + k), 0), 12) AS s FROM (SELECT query_id, chunk_id, pos AS d FROM {tag}_d) FULL JOIN (SELECT query_id, chunk_id, pos AS k FROM {tag}_k) USING (query_id, chunk_id)),
{tag} AS (SELECT query_id, chunk_id, rrf_score, pos FROM (SELECT query_id, chunk_id, s AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, d NULLS LAST, k NULLS LAST, chunk_id) - 1 AS pos FROM {tag}_b QUALIFY pos < {n}) WHERE chunk_id IN (SELECT chunk_id FROM {tag}_c))"""


def _described(hits: str) -> str:
    """CTE described(query_id, chunk_id, rrf_score, pos): overviews of described names of one hump that a query has as a word, first."""
    names = _values([(i, n.split(".")[-1]) for i, n in literals.DESCRIPTIONS], "ord, name")
    return f"""words AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z]{{3,}}')) AS w FROM {_ASKED}),
wanted AS (SELECT DISTINCT query_id, name, ord FROM words JOIN {names} n ON w = lower(name) QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY ord) <= 2),
known AS (SELECT query_id, arg_min(chunk_id, fqn || ' ' || chunk_id) AS chunk_id, any_value(ord) AS no FROM wanted JOIN {_DOCS} x ON x.class_name = name GROUP BY query_id, name),
{_promoted("described", "known", hits)}"""


_PLACED = "(SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)"
_CLASSES = f"""(SELECT 'c:' || fqn AS chunk_id, 'class_overview' AS type, fqn, class_name, NULL::VARCHAR AS method_name, package, 'public' AS visibility, extends, implements, 'class ' || class_name || chr(10) || '// Fields:' || chr(10) || 'int ' || lower(class_name) || ';' || chr(10) AS body FROM (
  SELECT 'world.' || r_name AS fqn, r_name AS class_name, 'world' AS package, '' AS extends, '' AS implements FROM region UNION ALL SELECT r_name || '.' || n_name, n_name, r_name, r_name, 'I' || (n_nationkey % 3) FROM {_PLACED}
  UNION ALL SELECT n_name || '.' || translate(s_name, '#', '_'), translate(s_name, '#', '_'), n_name, n_name, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey)
UNION ALL SELECT 'm:' || fqn || '#' || method_name, 'method', fqn, class_name, method_name, package, visibility, '', '', '/** about */' || chr(10) || '  ' || visibility || ' void ' || method_name || '()' || chr(10) FROM (
  SELECT r_name || '.' || n_name AS fqn, n_name AS class_name, translate(c_name, '#', '_') AS method_name, r_name AS package, ['public', 'protected', 'private'][c_custkey % 3 + 1] AS visibility FROM customer JOIN {_PLACED} ON c_nationkey = n_nationkey
  UNION ALL SELECT 'world.' || r_name, r_name, 'market' || r_regionkey, 'world', 'public' FROM region))"""
_SIGNATURE = "trim(string_split(body, chr(10))[2])"


def _per_class(hits: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fqn ORDER BY pos) AS rn FROM {hits}) WHERE rn <= 2 OR coalesce(fqn, '') = ''"


def _slots(hits: str, limit: int) -> str:
    place = "CASE source WHEN 'api' THEN 0 WHEN 'guide' THEN 1 WHEN 'mod' THEN 2 ELSE 3 END"
    quota = "CASE source WHEN 'api' THEN 2 WHEN 'guide' THEN 2 WHEN 'mod' THEN 1 ELSE 0 END"
    return f"""SELECT * EXCLUDE (rn, g, pos), row_number() OVER (PARTITION BY query_id ORDER BY g, pos) - 1 AS pos FROM (
  SELECT *, CASE WHEN rn > {quota} THEN 3 ELSE {place} END AS g FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS rn FROM {hits}))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY g, pos) <= {limit}"""


def _search_all(fetches: tuple[int, int, int]) -> str:
    legs = ("api", "guide", "mod")
    ctes = ", ".join(f"{_scores(s, f'(SELECT * FROM {_ALL} WHERE source = ' + repr(s) + ')', _WORDS)}, {_fused(s, n)}" for s, n in zip(legs, fetches, strict=True))
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, rrf_score, {i} AS leg, pos FROM {s}" for i, s in enumerate(legs))
    return f"""WITH {ctes},
hits AS (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY leg, pos) - 1 AS pos FROM ({union})),
{_boosted("hits", _ALL)},
ranked AS (SELECT query_id, chunk_id, rrf_score, x.source, x.fqn, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, pos) - 1 AS pos FROM boosted JOIN {_ALL} x USING (chunk_id)),
deduped AS ({_per_class("ranked")})
SELECT query_id, chunk_id, round(rrf_score, 9) AS score, pos::INT AS pos FROM ({_slots("deduped", 8)})"""


def _filled(template: str, **columns: str) -> str:
    """A text whose names between < and > are expressions."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return " || ".join(columns[part] if i % 2 else quoted(part) for i, part in enumerate(re.split("<([a-z]+)>", template)) if part)


def _members() -> str:
    """CTEs files(file, text) and members(file, name, constructor, start, stop): declarations by the depth of braces."""
    name = "replace(c_name, '#', '_')"
    method = _filled(literals.METHOD_TEXT, key="o_orderkey", word="lower(regexp_extract(o_orderpriority, '-([A-Z]+)', 1))", priority="o_orderpriority")
    text = _filled(literals.CLASS_TEXT, name=name, methods="coalesce(methods, '')")
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    flat = "translate(code, chr(10) || chr(13) || chr(9), '   ')"
    return f"""m0 AS (SELECT o_custkey, string_agg({method}, '' ORDER BY o_orderkey) AS methods FROM orders GROUP BY o_custkey),
files AS MATERIALIZED (SELECT 'shop/' || {name} || '.java' AS file, {text} AS text FROM customer LEFT JOIN m0 ON c_custkey = o_custkey),
m1 AS (SELECT file, unnest(range(len(p))) AS no, unnest(p) AS piece FROM (SELECT file, regexp_extract_all(text, {quoted(PIECES)}) AS p FROM files)),
m2 AS (SELECT *, CASE WHEN left(piece, 2) IN ('//', '/*') THEN ' ' WHEN length(piece) > 1 AND left(piece, 1) IN ('"', chr(39)) THEN '""' ELSE piece END AS code, sum(length(piece)) OVER w AS stop,
  sum(CASE piece WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS after FROM m1 WINDOW w AS (PARTITION BY file ORDER BY no)),
m3 AS (SELECT *, stop - length(piece) AS start, CASE WHEN piece = '}}' THEN after + 1 ELSE after END AS level,
  piece = '{{' AND coalesce(last_value(CASE WHEN trim({flat}) <> '' THEN right(rtrim({flat}), 1) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IN ('(', ',', '='), FALSE) AS is_list FROM m2),
m4 AS (SELECT *, lag(is_list) OVER w AS was, lead(stop) OVER w AS closes FROM m3 WINDOW w AS (PARTITION BY file, level, piece IN ('{{', '}}') ORDER BY no)),
m5 AS (SELECT *, piece = ';' OR piece = '{{' AND NOT is_list OR piece = '}}' AND NOT coalesce(was, FALSE) AS shapes FROM m4),
m6 AS (SELECT *, coalesce(sum(shapes::INT) OVER (PARTITION BY file ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, NOT shapes AND trim({flat}) <> '' AS solid FROM m5),
m7 AS (SELECT file, part, string_agg(code, '' ORDER BY no) FILTER (NOT shapes) AS code, arg_min(start, no) FILTER (solid) AS first, min(no) FILTER (solid) AS first_no, list({{'no': no, 'start': start}}) FILTER (starts_with(piece, '/**')) AS docs,
  any_value(piece) FILTER (shapes) AS piece, any_value(start) FILTER (shapes) AS close, any_value(closes) FILTER (shapes) AS closes FROM m6 GROUP BY file, part),
m8 AS (SELECT file, trim(regexp_replace(regexp_replace(code, {quoted(ANNOTATION)}, ' ', 'g'), '\\s+', ' ', 'g')) AS code, coalesce(list_max(list_filter(docs, lambda d: d.no < first_no)).start, first) AS start, CASE WHEN piece = '{{' THEN coalesce(closes, close) ELSE close END AS stop FROM m7 WHERE piece IN ('{{', ';') AND contains(code, '(')),
m9 AS (SELECT *, CASE WHEN regexp_matches(code, '\\brecord\\s+\\w+\\s*\\(') THEN '' ELSE regexp_extract(code, {quoted(METHOD)}, 1) END AS method, regexp_extract(code, {quoted(CONSTRUCTOR)}, 1) AS made FROM m8),
members AS (SELECT file, CASE WHEN method <> '' THEN method ELSE made END AS name, method = '' AND made <> '' AS constructor, start, stop FROM m9 WHERE method <> '' OR made <> '')"""


def statements() -> dict[str, str]:
    """SQL by name of query."""
    out: dict[str, str] = {}
    out["bm25_topk"] = f"WITH {_scores('k', _DOCS, _WORDS)} SELECT query_id, chunk_id, round(score, 6) AS score, pos::INT AS pos FROM ({_best('k', 10)})"
    items = f"(SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS phrase FROM benchmark)"
    out["bm25_batch_queries"] = f"WITH {_scores('k', _DOCS, items)} SELECT query_id, chunk_id, round(score, 6) AS score, pos::INT AS pos FROM ({_best('k', 5)})"
    words = TOKENS.format("body")
    pairs = "(SELECT query_id, lower(unnest(regexp_split_to_array(query, '\\s+'))) AS phrase FROM " + _values(literals.PHRASES, "query_id, query") + ")"
    out["phrase_topk"] = f"""WITH k_c AS (SELECT * FROM {_DOCS}), k_p AS (SELECT * FROM {pairs}),
k_t AS (SELECT chunk_id, unnest({words}) AS term, unnest(range(len({words}))) AS at FROM k_c),
k_l AS (SELECT chunk_id, len({words}) AS length FROM k_c), k_n AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM k_l),
k_f AS (SELECT a.chunk_id, p.phrase AS term, count(*)::DOUBLE AS f FROM (SELECT DISTINCT phrase FROM k_p) p JOIN k_t a ON a.term = split_part(p.phrase, '.', 1) JOIN k_t b ON b.chunk_id = a.chunk_id AND b.at = a.at + 1 AND b.term = split_part(p.phrase, '.', 2) GROUP BY ALL),
{_weighted('k')} SELECT query_id, chunk_id, round(score, 6) AS score, pos::INT AS pos FROM ({_best('k', 10)})"""
    humps = "regexp_extract_all(regexp_replace(regexp_replace(w, '([A-Z][a-z]+)', ' \\1 ', 'g'), '[A-Z]([^A-Za-z ])', ' \\1', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+')"
    out["query_parse_terms"] = f"""WITH w AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(trim(query), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}._]', '', 'g')), lambda w: length(w) >= 2 AND lower(w) NOT IN ({_STOP})) AS ws FROM (SELECT item_id AS query_id, text AS query FROM benchmark)),
p AS (SELECT query_id, flatten(list_transform(ws, lambda w: list_concat([w], CASE WHEN len({humps}) > 1 THEN list_filter({humps}, lambda h: length(h) >= 2 AND lower(h) NOT IN ({_STOP})) ELSE [] END))) AS ps FROM w)
SELECT query_id, unnest(range(len(ps)))::INT AS phrase_no, unnest(ps) AS phrase FROM p"""

    def stem(w: str) -> str:
        return f"""CASE WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3) WHEN {w} LIKE '%tion' AND length({w}) > 6 THEN left({w}, length({w}) - 4) WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN left({w}, length({w}) - 2)
WHEN {w} LIKE '%ly' AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 4 THEN left({w}, length({w}) - 1) ELSE {w} END"""

    out["mini_stem_df"] = f"SELECT stem, count(DISTINCT id) AS df FROM (SELECT row_number() OVER () AS id, {TOKENS.format('text')} AS ws FROM documents), LATERAL (SELECT {stem('w')} AS stem FROM (SELECT unnest(ws) AS w)) GROUP BY stem"
    out["postings_stats"] = f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT row_number() OVER () AS id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term"
    out["vector_topk"] = f"SELECT query_id, chunk_id, round(similarity, 6) AS similarity, pos::INT AS pos FROM ({_near(10)})"
    out["vector_index_topk"] = out["vector_topk"]
    out["vector_topk_filtered"] = f"SELECT query_id, chunk_id, round(similarity, 6) AS similarity, pos::INT AS pos FROM ({_near(5, 'a.label = 3')})"
    out["recall_at_k"] = f"""WITH n AS ({_near(10)}), r AS (SELECT q.vec_id AS query_id, a.vec_id AS chunk_id FROM embeddings a JOIN embeddings q ON a.label = q.label WHERE q.vec_id % 50 = 0)
SELECT query_id, round(count(n.chunk_id) / count(*)::DOUBLE, 6) AS recall FROM r LEFT JOIN n USING (query_id, chunk_id) GROUP BY query_id"""
    out["prefix_filter"] = "SELECT p_partkey, p_name, p_type FROM part WHERE starts_with(p_type, 'S') AND starts_with(p_name, 'red ')"
    out["rrf_fusion"] = f"""WITH {_scores('k', _DOCS, _WORDS)}, kw AS ({_best('k', 30)}),
g AS (SELECT 'd' || doc_id AS chunk_id, row_number() OVER (ORDER BY quality DESC, n_chars DESC, doc_id) - 1 AS d FROM labels JOIN documents USING (doc_id) QUALIFY d < 30),
dn AS (SELECT query_id, chunk_id, d FROM g, {_ASKED}),
b AS (SELECT query_id, chunk_id, d, k, round(coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(0.3::DOUBLE / (60 + k), 0), 12) AS s FROM dn FULL JOIN (SELECT query_id, chunk_id, pos AS k FROM kw) USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(s, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, d NULLS LAST, k NULLS LAST, chunk_id) - 1)::INT AS pos FROM b QUALIFY pos < 10"""
    out["identifier_gate"] = "SELECT lang, count(*) FILTER (regexp_matches(text, '[A-Z._]')) AS named, count(*) AS total FROM documents GROUP BY lang"
    by_length = "(SELECT source AS query_id, 'd' || doc_id AS chunk_id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents)"
    out["dedup_per_key"] = f"SELECT query_id, chunk_id, pos::INT AS pos FROM ({_per_class('(SELECT *, CASE WHEN lang = ' + repr('en') + ' THEN ' + repr('') + ' ELSE lang END AS fqn FROM ' + by_length + ')')})"
    sourced = f"(SELECT query_id, chunk_id, pos, CASE lang WHEN 'en' THEN 'api' WHEN 'fr' THEN 'guide' WHEN 'de' THEN 'mod' ELSE 'other' END AS source FROM {by_length})"
    out["source_slots"] = f"SELECT query_id, chunk_id, pos::INT AS pos FROM ({_slots(sourced, 8)})"
    out["exact_boost"] = f"WITH {_scores('k', _DOCS, _WORDS)}, hits AS (SELECT query_id, chunk_id, round(0.3 / (60 + pos), 12) AS rrf_score, pos FROM ({_best('k', 10)})), {_boosted('hits', _DOCS)} SELECT query_id, chunk_id, round(rrf_score, 9) AS score, pos::INT AS pos FROM boosted"
    out["token_overlap_boost"] = f"""WITH n AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name),
s AS (SELECT DISTINCT ord, name, {stem('w')} AS stem FROM (SELECT ord, name, unnest(string_split(lower(name), ' ')) AS w FROM n)),
z AS (SELECT name, count(*) AS size FROM s GROUP BY name), r AS (SELECT stem, count(*) AS df FROM s GROUP BY stem),
a AS (SELECT DISTINCT query_id, {stem('w')} AS stem FROM (SELECT query_id, unnest(string_split(lower(query), ' ')) AS w FROM {_values(literals.OVERLAPS, 'query_id, query')})),
m AS (SELECT query_id, ord, name, size, count(*) AS shared, max(stem) AS one FROM a JOIN s USING (stem) JOIN z USING (name) WHERE query_id IN (SELECT query_id FROM a GROUP BY query_id HAVING count(*) >= 2) GROUP BY ALL)
SELECT query_id, name, round(shared / size::DOUBLE, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY shared / size::DOUBLE DESC, ord))::INT AS no FROM m JOIN r ON r.stem = one WHERE shared >= 2 OR (size <= 2 AND length(one) >= 5 AND df <= 4) QUALIFY no <= 2"""
    out["bridge_boost"] = f"""WITH g AS (SELECT (page_id % 7)::INT AS query_id, nullif(regexp_extract(html, '<h1>([A-Z][a-z]{{4,}})', 1), '') AS name, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS pos FROM pages),
n AS (SELECT query_id, name, min(pos) AS pos FROM g WHERE pos < 6 AND name IS NOT NULL GROUP BY ALL),
f AS (SELECT query_id, pos, arg_min(chunk_id, fqn || ' ' || chunk_id) AS chunk_id FROM n JOIN {_DOCS} x ON x.class_name = n.name GROUP BY query_id, name, pos),
b AS (SELECT query_id, chunk_id, min(pos) AS pos FROM f GROUP BY ALL), s AS (SELECT chunk_id FROM {_DOCS} ORDER BY chunk_id LIMIT 5),
h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS pos FROM (SELECT DISTINCT query_id FROM g), s)
SELECT query_id, chunk_id, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY part, pos, chunk_id) - 1)::INT AS pos FROM (SELECT query_id, chunk_id, 1.0::DOUBLE AS score, 0 AS part, pos FROM b
  UNION ALL SELECT query_id, chunk_id, 0.01, 1, pos FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = h.query_id AND b.chunk_id = h.chunk_id))"""
    # No heading here has a name of several humps or between backticks, so the bridge adds nothing (bridge_boost shows it at work).
    out["search_all_pipeline"] = _search_all((15, 10, 7))
    out["dashboard_search"] = _search_all((10, 10, 10))
    api = f"(SELECT * FROM {_ALL} WHERE source = 'api')"
    one = f"(SELECT * FROM {_ALL} WHERE source = 'api' AND starts_with(coalesce(package, ''), 'src1'))"

    def single(rows: str) -> str:
        return f"""WITH {_scores('k', api, _WORDS)}, {_fused('k', 30, f'chunk_id IN (SELECT chunk_id FROM {rows})')}, {_boosted('k', rows)},
r AS (SELECT query_id, chunk_id, rrf_score, fqn, pos FROM boosted JOIN {rows} x USING (chunk_id)), d AS ({_per_class('r')})
SELECT query_id, chunk_id, round(rrf_score, 9) AS score, (p - 1)::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM d) WHERE p <= 8"""

    out["search_single_pipeline"] = single(one)
    out["search_api_by_type"] = f"SELECT 'class_overview' AS kind, * FROM ({single(api)})"
    leg = lambda source, n: f"WITH {_scores('k', f'(SELECT * FROM {_ALL} WHERE source = ' + repr(source) + ')', _WORDS)}, {_fused('k', 30)} SELECT query_id, chunk_id, round(rrf_score, 9) AS score, pos::INT AS pos FROM k WHERE pos < {n}"
    out["search_guides_pipeline"] = out["dashboard_guides"] = leg("guide", 8)
    out["search_mods_pipeline"] = leg("mod", 8)
    out["dashboard_package"] = f"""WITH {_scores('k', api, _WORDS)}, {_fused('k', 30)}, {_boosted('k', _ALL)},
r AS (SELECT query_id, chunk_id, rrf_score, fqn, package, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, pos) AS pos FROM boosted JOIN {_ALL} x USING (chunk_id)), d AS ({_per_class('r')})
SELECT query_id, chunk_id, round(rrf_score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1)::INT AS pos FROM d WHERE contains(coalesce(package, ''), 'rc1') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 8"""
    legs = ", ".join(_hybrid(s, s, n) for s, n in (("api", 15), ("guide", 10), ("mod", 7)))
    out["hybrid_all_pipeline"] = f"""WITH {legs}, {_described('api')},
hits AS (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY leg, pos) - 1 AS pos FROM (SELECT *, 0 AS leg FROM described UNION ALL SELECT *, 1 FROM guide UNION ALL SELECT *, 2 FROM mod)),
{_boosted("hits", _ALL)},
ranked AS (SELECT query_id, chunk_id, rrf_score, x.source, x.fqn, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, pos) - 1 AS pos FROM boosted JOIN {_ALL} x USING (chunk_id)), deduped AS ({_per_class("ranked")})
SELECT query_id, chunk_id, round(rrf_score, 9) AS score, pos::INT AS pos FROM ({_slots("deduped", 8)})"""
    boards = ", ".join(_hybrid(s, s, 10) for s in ("api", "guide", "mod"))
    out["hybrid_dashboard"] = f"""WITH {boards},
hits AS (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY leg, pos) - 1 AS pos FROM (SELECT query_id, chunk_id, rrf_score, pos, 0 AS leg FROM api UNION ALL SELECT query_id, chunk_id, rrf_score, pos, 1 FROM guide UNION ALL SELECT query_id, chunk_id, rrf_score, pos, 2 FROM mod)),
{_boosted("hits", _ALL)},
ranked AS (SELECT query_id, chunk_id, rrf_score, x.source, x.fqn, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, pos) - 1 AS pos FROM boosted JOIN {_ALL} x USING (chunk_id)), deduped AS ({_per_class("ranked")})
SELECT query_id, chunk_id, round(rrf_score, 9) AS score, pos::INT AS pos FROM ({_slots("deduped", 8)})"""
    out["chunk_bodies"] = "SELECT 'd' || doc_id AS chunk_id, source, CASE WHEN doc_id % 3 <> 0 THEN length(coalesce(text, '')) ELSE 0 END AS size, md5(CASE WHEN doc_id % 3 <> 0 THEN coalesce(text, '') ELSE '' END) AS digest FROM documents"
    out["hybrid_api_pipeline"] = f"""WITH {_hybrid('api', 'api', 30)}, {_boosted('api', _ALL)}, {_described('boosted')},
r AS (SELECT query_id, chunk_id, rrf_score, fqn, pos FROM described JOIN {_ALL} x USING (chunk_id)), d AS ({_per_class('r')})
SELECT query_id, chunk_id, round(rrf_score, 9) AS score, (p - 1)::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM d) WHERE p <= 8"""
    out["hybrid_guides_pipeline"] = f"WITH {_hybrid('guide', 'guide', 30)} SELECT query_id, chunk_id, round(rrf_score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1)::INT AS pos FROM guide QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 8"
    out["rendered_results"] = f"""SELECT query_id, string_agg('**Result ' || (pos + 1) || '** [GUIDE] | ' || CASE WHEN heading <> '' THEN heading || ' | ' ELSE '' END || 'score ' || printf('%.4f', score) || chr(10) || html, chr(10) || chr(10) ORDER BY pos) AS text
FROM ({leg('guide', 2)}) JOIN (SELECT 'p' || page_id AS chunk_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, html FROM pages) USING (chunk_id) GROUP BY query_id"""
    out["json_results"] = f"SELECT query_id, pos, chunk_id AS id, 'mod' AS source, CASE WHEN length(body) > 500 THEN substr(body, 1, 500) || '...' ELSE coalesce(body, '') END AS text FROM ({leg('mod', 3)}) JOIN (SELECT chunk_id, body FROM {_ALL}) USING (chunk_id)"
    out["index_fallback"] = f"""WITH {_scores('k', _DOCS, _WORDS)} SELECT query_id, chunk_id, pos::INT AS pos, fqn, CASE WHEN substr(chunk_id, 2)::BIGINT % 2 = 0 THEN 'stored' ELSE class_name END AS class_name, length(body)::INT AS size, substr(chunk_id, 2)::BIGINT % 2 = 1 AS from_index
FROM ({_best('k', 10)}) JOIN {_DOCS} x USING (chunk_id)"""
    asked = "(SELECT query_id, unnest(" + TOKENS.format("query") + ") AS phrase FROM " + _values(literals.FIELD_QUERIES, "query_id, query") + ")"
    fields = f"(SELECT chunk_id, concat_ws(' ', fqn, class_name, body) AS body FROM {_DOCS})"
    out["bm25_fields"] = f"WITH {_scores('k', fields, asked)} SELECT query_id, chunk_id, round(score, 6) AS score, pos::INT AS pos FROM ({_best('k', 10)})"
    out["index_build"] = f"""WITH l AS (SELECT source, {words} AS ws FROM {_ALL}), t AS (SELECT source, unnest(ws) AS term FROM l)
SELECT source, tokens, terms, chunks, average FROM (SELECT source, count(*) AS tokens, count(DISTINCT term) AS terms FROM t GROUP BY source) JOIN (SELECT source, count(*) AS chunks, round(avg(len(ws)), 6) AS average FROM l GROUP BY source) USING (source)"""
    out["package_totals"] = "SELECT count(*) AS packages, sum(n)::BIGINT AS classes FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)"
    out["inherited_methods"] = f"""WITH k AS {_CLASSES}, s AS (SELECT s_suppkey AS query_id, n_name, r_name FROM supplier JOIN {_PLACED} ON s_nationkey = n_nationkey WHERE s_suppkey % 50 = 0),
up AS (SELECT query_id, 0 AS depth, r_name || '.' || n_name AS fqn FROM s UNION ALL SELECT query_id, 1, 'world.' || r_name FROM s)
SELECT query_id, depth, class_name, fqn, method_name, {_SIGNATURE} AS signature FROM up JOIN k USING (fqn) WHERE type = 'method' AND visibility IN ('public', 'protected')"""
    named = _values(literals.CLASS_NAMES, "query_id, name")
    found = f"""k AS {_CLASSES}, n AS {named}, e AS (SELECT query_id, name, 0 AS tier, 0 AS distance, k.* FROM n JOIN k ON CASE WHEN contains(name, '.') THEN fqn = name ELSE class_name = name AND type = 'class_overview' END),
m AS (SELECT query_id, name, 3 AS tier, levenshtein(class_name, name) AS distance, k.* FROM n, k WHERE type = 'class_overview' AND query_id NOT IN (SELECT query_id FROM e) AND levenshtein(class_name, name) <= length(name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, class_name, chunk_id) <= 5),
f AS (SELECT * FROM e UNION ALL SELECT * FROM m)"""
    out["class_info"] = f"WITH {found} SELECT query_id, tier, chunk_id, length(body)::INT AS size FROM f"
    out["class_report"] = f"""WITH {found}, o AS (SELECT query_id, any_value(name) AS name, any_value(tier) AS tier, string_agg('### ' || fqn || ' (' || type || ')' || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY fqn, chunk_id) AS parts,
  string_agg('  - ' || fqn, chr(10) ORDER BY distance, fqn) AS near, min(extends) FILTER (type = 'class_overview' AND tier = 0) AS up FROM f GROUP BY query_id),
i AS (SELECT query_id, string_agg('  ' || {_SIGNATURE} || ';  // inherited from ' || fqn, chr(10) ORDER BY method_name) AS lines FROM o JOIN k ON class_name = up WHERE type = 'method' AND visibility IN ('public', 'protected') GROUP BY query_id)
SELECT query_id, CASE WHEN tier = 0 THEN parts || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### Inherited Methods' || chr(10) || lines END ELSE 'Class ' || chr(39) || name || chr(39) || ' not found exactly. Did you mean:' || chr(10) || near END AS text FROM o LEFT JOIN i USING (query_id)"""
    out["class_hierarchy"] = f"""WITH k AS (SELECT * FROM {_CLASSES} WHERE type = 'class_overview'), c AS (SELECT extends AS name, count(DISTINCT fqn)::INT AS n, array_to_string(list_sort(list(DISTINCT fqn))[1:30], ',') AS shown FROM k GROUP BY extends)
SELECT query_id, fqn, extends, implements, CASE WHEN extends <> '' THEN '' END AS parent_extends, n AS n_subclasses, coalesce(shown, '') AS subclasses FROM (SELECT r_regionkey AS query_id, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation) q JOIN k ON class_name = q.name LEFT JOIN c ON c.name = q.name"""
    out["method_boost"] = f"""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY no, chunk_id)::INT AS ord FROM (SELECT query_id, no, chunk_id FROM {_CLASSES} JOIN (VALUES (1, 0, 'EUROPE'), (1, 1, 'ASIA'), (2, 0, 'NATION_7')) t(query_id, no, class_name) USING (class_name) WHERE type = 'method'
  QUALIFY row_number() OVER (PARTITION BY query_id, no ORDER BY chunk_id) <= 3)"""
    out["api_snapshot"] = f"""WITH k AS {_CLASSES} SELECT fqn, class_name, package, extends, implements, coalesce(methods, '') AS methods, 'int ' || lower(class_name) AS fields FROM k LEFT JOIN (SELECT fqn, array_to_string(list_sort(list(DISTINCT method_name)), ',') AS methods FROM k WHERE type = 'method' GROUP BY fqn) USING (fqn) WHERE type = 'class_overview'"""
    line = lambda k: f"CASE WHEN {k} > 0 THEN '{k} (' || {k} || '): ' || {k}_shown END"
    kinds = ("added", "removed", "modified")
    out["metadata_scan"] = "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 14, 23) AND p_brand IS DISTINCT FROM 'Brand#13' AND p_retailprice >= 950 AND p_retailprice < 1800 ORDER BY p_partkey LIMIT 40 OFFSET 5"
    out["files_by_folder"] = "SELECT folder, count(*) AS files FROM (SELECT regexp_extract(url, '^(?:[a-z]+://)?/*([^/]+)/', 1) AS folder FROM pages) WHERE folder <> '' GROUP BY folder"
    second = "coalesce(string_split(text, chr(10))[2], text)"
    label = "concat_ws(' ', source, lang, 'a/b ' || doc_id)"
    out["text_functions"] = f"SELECT doc_id, CASE WHEN length({second}) > 200 THEN substr({second}, 1, 200) || '...' ELSE {second} END AS second, substr(translate({label}, ' /', '__'), 1, 30) AS label, regexp_replace({label}, '[^A-Za-z0-9]', '', 'g') AS name, coalesce(substr(md5(text), 1, 16) || '...', '') AS digest, format('{{:,}}', n_chars) AS shown FROM documents"
    out["package_rollup"] = "SELECT p_brand AS package, len(a)::INT AS classes, array_to_string(a[1:20], ',') AS shown, greatest(len(a) - 20, 0)::INT AS more FROM (SELECT p_brand, list_sort(list(p_name)) AS a FROM part GROUP BY p_brand)"
    nations = "(SELECT r_name || '.' || n_name AS fqn, r_name AS extends, r_name || ' , I' || (n_nationkey % 3) AS implements FROM nation JOIN region ON n_regionkey = r_regionkey)"
    out["subclass_lookup"] = f"SELECT r_regionkey AS query_id, len(a)::INT AS total, array_to_string(a[1:30], ',') AS shown FROM (SELECT r_regionkey, list_sort(list(DISTINCT fqn)) AS a FROM region JOIN {nations} ON extends = r_name GROUP BY r_regionkey)"
    out["implementors"] = f"SELECT query_id, len(a)::INT AS total, array_to_string(a[1:30], ',') AS shown FROM (SELECT query_id, list_sort(list(fqn)) AS a FROM (SELECT fqn, trim(unnest(string_split(implements, ','))) AS i FROM {nations}) JOIN (VALUES (0, 'I0'), (1, 'I1'), (2, 'I2'), (3, 'ASIA')) t(query_id, name) ON i = name GROUP BY query_id)"
    out["recursive_ancestors"] = """WITH RECURSIVE n AS (SELECT conv_id || '_' || turn AS name, CASE WHEN turn > 0 THEN conv_id || '_' || (turn - 1) ELSE '' END AS parent, turn FROM conversations),
w(query_id, depth, name) AS (SELECT name, 0, parent FROM n WHERE turn = 7 AND parent <> '' UNION ALL SELECT w.query_id, w.depth + 1, n.parent FROM w JOIN n ON n.name = w.name WHERE n.parent <> '' AND w.depth + 1 < 6)
SELECT query_id, depth::INT AS depth, name FROM w"""

    def used(rows: str, name: str) -> str:
        return f"SELECT file, line, left(trim(raw), 200) AS text FROM (SELECT file, unnest(ls) AS raw, unnest(range(1, len(ls) + 1))::INT AS line FROM (SELECT file, string_split(text, chr(10)) AS ls FROM {rows})) WHERE regexp_matches(raw, '(^|[^\\p{{L}}\\p{{N}}_]){name}([^\\p{{L}}\\p{{N}}_]|$)') AND NOT starts_with(trim(raw), 'package ')"

    out["find_usages"] = used("(SELECT doc_id AS file, text FROM documents)", "on")
    out["find_usages_topk"] = f"""SELECT file, line, text FROM (SELECT * FROM (SELECT *, 0 AS part FROM ({used('(SELECT doc_id AS file, text FROM documents)', 'stupid')}) ORDER BY file, line LIMIT 30)
  UNION ALL SELECT *, 1 FROM ({used('(SELECT page_id AS file, html AS text FROM pages)', 'stupid')})) ORDER BY part, file, line LIMIT 10"""
    parts = """(SELECT p_partkey AS id, 'class P' || p_partkey || CASE WHEN p_size % 5 = 0 THEN chr(10) || '// Extends: Q' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN chr(10) ELSE chr(10) || '// Fields:' || chr(10) || '  int size' || p_size || ';' || chr(10) || chr(10) || ' ' || replace(p_type, ' ', '_') || ' kind ;;' || chr(10) || replace(p_name, ' ', ';') || chr(10) END
  || CASE p_size % 3 WHEN 0 THEN '// Methods:' || chr(10) || 'run();' WHEN 1 THEN '// Implements: A, B' || chr(10) || '// Inherited methods:' || chr(10) || 'int y;' ELSE '' END AS body FROM part)"""
    out["field_section"] = f"""SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_extract(body, '(?s)// Fields:(.*?)(?:// Methods:|// Extends:|// Implements:|// Inherited methods:|$)', 1), chr(10)), lambda x: trim(regexp_replace(trim(x), ';+$', ''))), lambda x: x <> ''), '|') AS fields FROM {parts}"""
    out["example_usages"] = f"""WITH a AS (SELECT 'api' AS source, 0 AS part, 0 AS pos, file, line, text FROM ({used("(SELECT printf('%012d', doc_id) AS file, text FROM documents)", literals.USED)}) ORDER BY file, line LIMIT 40),
{_scores('k', f"(SELECT * FROM {_ALL} WHERE source = 'mod')", f"(SELECT 1 AS query_id, '{literals.USED}' AS phrase)")}, b AS (SELECT 'mod:' || CASE WHEN ends_with(chunk_id, '_0') THEN '?' ELSE regexp_extract(chunk_id, '^c([0-9]+)_', 1) END AS source, 1 AS part, pos, chunk_id AS file, 0 AS line, left(body, 200) AS text FROM ({_best('k', 10)}) JOIN {_ALL} x USING (chunk_id))
SELECT row_number() OVER (ORDER BY part, pos, file, line)::INT AS no, source, file, line::INT AS line, text FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY no <= 40"""
    out["class_members"] = f"WITH {_members()} SELECT file, name, constructor, start::BIGINT AS start, stop::BIGINT AS stop FROM members"
    name = "replace(c_name, '#', '_')"
    out["method_span"] = f"""WITH {_members()},
asked AS (SELECT c_custkey * 10 + no AS query_id, c_custkey AS k, {name} AS own, CASE WHEN c_custkey % 20 = 0 THEN 'shop.' || {name} WHEN c_custkey % 50 = 0 THEN 'Nobody' ELSE {name} END AS class_name, m
  FROM customer, (VALUES (0, 'urgent'), (1, '<init>'), (2, 'low'), (3, 'absent')) t(no, m) WHERE c_custkey % 10 = 0),
bodies AS (SELECT query_id, string_agg(regexp_replace(substr(text, start::BIGINT + 1, (stop - start)::BIGINT), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) || '// ---' || chr(10) || chr(10) ORDER BY start) AS s
  FROM asked JOIN members ON file = 'shop/' || own || '.java' AND constructor = (m = '<init>') AND name = CASE WHEN m = '<init>' THEN own ELSE m END JOIN files USING (file) GROUP BY query_id)
SELECT query_id, CASE WHEN class_name = 'Nobody' THEN 'Class ''Nobody'' not found.' WHEN k % 7 = 1 THEN 'No file path found for this class.' WHEN k % 7 = 2 THEN 'Source file not found: gone/' || own
  WHEN s IS NULL THEN 'Method ''' || m || ''' not found in ' || class_name || '.' ELSE '// shop.' || own || '.' || m || ' — full source' || chr(10) || chr(10) || s END AS text FROM asked LEFT JOIN bodies USING (query_id)"""
    out["snapshot_build"] = "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS states FROM lineitem GROUP BY l_orderkey"
    half = "(SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders WHERE o_orderdate {0} TIMESTAMP '{1}' GROUP BY o_custkey)"
    listed = lambda label, a, b: f"CASE WHEN len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0 THEN '{label}: ' || array_to_string(list_filter({a}, lambda x: NOT list_contains({b}, x)), ', ') END"
    out["snapshot_diff"] = f"""SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' ELSE 'modified' END AS kind,
CASE WHEN o.p IS NULL OR n.p IS NULL THEN '' ELSE concat_ws('; ', {listed('priorities added', 'n.p', 'o.p')}, {listed('priorities removed', 'o.p', 'n.p')}) END AS changes
FROM {half.format('<', literals.CUT)} o FULL JOIN {half.format('>=', literals.CUT)} n ON o.o_custkey = n.o_custkey WHERE o.p IS NULL OR n.p IS NULL OR o.p <> n.p"""
    out["indexed_usages"] = used("(SELECT doc_id AS file, text FROM documents)", literals.USED)
    grouped = "(SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders JOIN customer ON o_custkey = c_custkey WHERE {0} GROUP BY o_custkey)"
    was = grouped.format(f"c_mktsegment <> '{literals.SEGMENT}' OR o_orderdate < TIMESTAMP '{literals.CUT}'")
    out["snapshot_diff_by_group"] = f"""SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' ELSE 'modified' END AS kind,
CASE WHEN o.p IS NULL OR n.p IS NULL THEN '' ELSE concat_ws('; ', {listed('priorities added', 'n.p', 'o.p')}, {listed('priorities removed', 'o.p', 'n.p')}) END AS changes
FROM {was} o FULL JOIN {grouped.format('TRUE')} n ON o.o_custkey = n.o_custkey WHERE o.p IS NULL OR n.p IS NULL OR o.p <> n.p"""
    out["diff_summary"] = f"""WITH d AS (SELECT o_custkey::VARCHAR AS k, kind FROM ({out["snapshot_diff"]})), c AS (SELECT {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}, array_to_string(list_sort(list(k) FILTER (kind = '{k}'))[1:20], ', ') AS {k}_shown" for k in kinds)} FROM d)
SELECT added, removed, modified, concat_ws(chr(10), {', '.join(map(line, kinds))}) AS summary FROM c"""
    out["chunk_windows"] = "SELECT id, k::INT AS chunk_no, substr(text, k * 1300 + 1, 1500) AS body FROM (SELECT doc_id AS id, text, unnest(range(greatest(ceil((length(text) - 200) / 1300.0)::BIGINT, 1))) AS k FROM documents WHERE length(text) > 0)"
    out["index_status"] = f"SELECT collection, coalesce(n, 0) AS chunks, coalesce(n, 0) > 0 AS indexed, indexed_at, embed_model, repo_count::BIGINT AS repo_count FROM {_values(literals.META, 'collection, indexed_at, embed_model, repo_count')} LEFT JOIN (SELECT source, count(*) AS n FROM {_ALL} GROUP BY source) ON source = collection"
    assets = "(SELECT CASE WHEN p_size % 4 = 0 THEN 'notes-' ELSE 'data-' END || p_brand || CASE WHEN p_size % 3 = 0 THEN '-vectors-' ELSE '-' END || p_partkey || '.zip' AS name, p_partkey * 1000 + p_size AS size FROM part)"
    out["tier_asset_sizes"] = f"SELECT 'lite' AS tier, count(*) AS files, sum(size)::BIGINT AS size FROM {assets} WHERE name LIKE 'data-%' AND name NOT LIKE '%-vectors-%' UNION ALL SELECT 'full', count(*), sum(size)::BIGINT FROM {assets} WHERE name LIKE 'data-%'"
    jobs = "(SELECT event_id AS job_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts FROM events)"
    out["job_status"] = f"SELECT job_id, status FROM {jobs} WHERE status = 'running' UNION ALL (SELECT job_id, status FROM {jobs} WHERE status <> 'running' ORDER BY ts DESC, job_id DESC LIMIT 5)"
    out["log_tail"] = "SELECT event_id AS log_id, event_type AS level, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 500"
    out["class_hits_by_source"] = f"SELECT source, count(*) AS chunks, count(DISTINCT fqn) AS classes FROM {_ALL} GROUP BY source"
    out["last_writer"] = "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"
    return out
