"""Personal data: patterns, and information-theoretic sanitisation of the words that disclose it.

Everything here is DataFrame expressions: no Python runs on the executors.

Base spans are matches of four patterns. Their values are the protected entities. A term (a word of letters) discloses an
entity as far as knowing the term points to it, by counts over the whole corpus; entity and term meet where they stand
in one document, however far apart. With p = df(t) / N, and the share of an entity's documents that have the term shrunk
by one document more in which the term stands as often as anywhere,

    disclosure(e, t) = log(((n(e, t) + p) / (df(e) + 1)) / p) / log(N / df(e)),

so an entity of one text is judged too, a chance meeting counts half, and many meetings count in full. A term that reaches
the threshold for an entity of its document is generalised: to the words that share its first four letters, else to those
that share its first two, whichever class is the first to stay under the threshold itself; where none does, it is removed.
A document without base spans is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_join

#: Kinds in their order, with pattern, a cheap condition that every match implies, and what becomes of a match.
#: Possessive repeats give the same matches and cannot backtrack; a match starts a run or follows the match before.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"
#: Disclosure from which a term or a class of terms points to an entity.
THRESHOLD = 0.85
#: Letters that the classes of a term keep, from the narrowest on, and what a verdict is called.
CLASSES = (4, 2)
VERDICTS = ("prefix4", "prefix2", "removed")
BLOCK = 256
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}

_SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        octet = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
        return value.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda s: _valid(kind, s["value"])


def find(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern as spans in code points, leftmost and not overlapping.

    Start positions are sums of the lengths of gaps and matches before, taken in blocks so that a text with very many
    matches costs about their number to the power of one and a half.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(F.coalesce(F.length(g), F.lit(0)).cast("bigint").alias("gap"), m.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    count = F.floor((F.size(pairs) + BLOCK - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))
    empty = F.expr("cast(array() as array<bigint>)")
    block_size = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, p: acc + p["gap"] + F.length(p["value"]))
    offsets = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")),
        lambda acc, b: F.struct((acc["at"] + block_size(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def span(at: Column, p: Column) -> Column:
        start = at + p["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(p["value"])).alias("end"), p["value"].alias("value"))

    spans = F.zip_with(
        blocks,
        offsets,
        lambda b, o: F.aggregate(
            b,
            F.struct(o.alias("at"), none.alias("out")),
            lambda acc, p: F.struct((acc["at"] + p["gap"] + F.length(p["value"])).alias("at"), F.concat(acc["out"], F.array(span(acc["at"], p))).alias("out")),
            lambda acc: acc["out"],
        ),
    )
    return F.when(F.size(matches) > 0, F.flatten(spans)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Valid spans of the four kinds, by start, then kind."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    guards = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"),
        "phone": text.contains("+"),
    }
    parts = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=False)):
        found = find(text, pattern, k)
        parts.append(F.when(guards[kind], F.filter(found, _checker(kind))).otherwise(none))
    return F.when(text.isNull(), none).otherwise(F.sort_array(F.concat(*parts)))


def _key(text: Column) -> Column:
    """A key of 128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def _class(word: Column, letters: int) -> Column:
    """The class of a small-lettered word; null where the word is no longer than its class."""
    return F.when(F.length(word) > letters, F.concat(F.substring(word, 1, letters), F.lit("*")))


def free_terms(text: Column, spans: Column) -> Column:
    """All terms of a text that no base span touches: (term, wide, wider, start, end), the first three as hashes."""
    free = F.filter(find(text, TERM, 4), lambda t: ~F.exists(spans, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))

    def item(t: Column) -> Column:
        word = F.lower(t["value"])
        classes = [F.when(F.length(word) > n, F.xxhash64(_class(word, n))) for n in CLASSES]
        return F.struct(F.xxhash64(word).alias("term"), classes[0].alias("wide"), classes[1].alias("wider"), t["start"].alias("start"), t["end"].alias("end"))

    return F.transform(free, item)


def find_base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns, a key of the text, base spans and, where there are any, entities and free terms; written once to the shared folder."""
    rows = docs.select(*keep, "text", _key(F.col("text")).alias("__key"), base_spans(F.col("text")).alias("__spans"))
    some = F.size("__spans") > 0
    entities = F.array_distinct(F.transform("__spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    return cut(rows.select(*keep, "__key", "__spans", F.when(some, entities).alias("__entities"), F.when(some, free_terms(F.col("text"), F.col("__spans"))).alias("__words")))


def document_counts(docs: DataFrame) -> DataFrame:
    """(item, df) of all terms and classes of terms, summed before the shuffle."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    items = F.flatten(F.transform(words, lambda w: F.array(F.xxhash64(w), *[F.when(F.length(w) > n, F.xxhash64(_class(w, n))) for n in CLASSES])))
    return docs.select(F.explode(F.array_compact(F.array_distinct(items))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))


def disclosing(docs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(__key, item): the terms and classes of each text that disclose an entity of it.

    ``texts`` has __key, copies, __entities and __words. Entities of the same texts have the same counts and are one, so
    a list of contacts is no product with its words. Entities that stand in every document have nothing to disclose.
    """
    n = float(max(docs.count(), 2))
    held = texts.select("__key", "copies", F.explode("__entities").alias("entity"))
    alike = held.groupBy("entity").agg(F.sum("copies").alias("df_entity"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("__key")).alias("a"), F.bit_xor(F.xxhash64("__key", F.lit(1))).alias("b"))
    alike = cut(alike.where(F.col("df_entity") < n).select("entity", "df_entity", "n", F.xxhash64("df_entity", "n", "a", "b").alias("group")))
    groups = cut(heavy_join(held, alike, ["entity"], "n").select("__key", "group", "df_entity").distinct())
    items = F.array_compact(F.array_distinct(F.flatten(F.transform("__words", lambda w: F.array(w["term"], w["wide"], w["wider"])))))
    words = texts.select("__key", "copies", F.explode(items).alias("item"))
    counts = cut(document_counts(docs).join(words.select("item").distinct(), "item", "left_semi"))
    content = lambda c: F.log(F.lit(n) / F.col(c))
    # No meeting is worth more than the item's own content, so items that are too common for all entities of a text go first.
    most = groups.groupBy("__key").agg(F.max("df_entity").alias("most"))
    rare = heavy_join(words.join(most, "__key"), counts, ["item"], "df").where(content("df") >= threshold * content("most"))
    met = cut(rare.join(groups, "__key").where(content("df") >= threshold * content("df_entity")).select("__key", "item", "copies", "df", "group", "df_entity"))
    both = met.groupBy("group", "item").agg(F.sum("copies").alias("both"), F.any_value("df").alias("df"), F.any_value("df_entity").alias("df_entity"))
    p = F.col("df") / n
    verdicts = both.where(F.log((F.col("both") + p) / (F.col("df_entity") + 1) / p) / content("df_entity") >= threshold).select("group", "item", "both")
    return cut(heavy_join(met, cut(verdicts), ["group", "item"], "both").select("__key", "item").distinct())


def term_spans(docs: DataFrame, base: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each text that has any: copies and __terms, its term spans (start, end, verdict) in order.

    Every occurrence of a term that discloses is a span; the verdict numbers VERDICTS from 0.
    """
    texts = base.where(F.size("__spans") > 0).groupBy("__key").agg(F.count(F.lit(1)).alias("copies"), F.any_value("__entities").alias("__entities"), F.any_value("__words").alias("__words"))
    texts = cut(texts)
    bad = disclosing(docs, texts, threshold)
    places = texts.select("__key", F.explode("__words").alias("w")).select("__key", "w.*")
    terms = places.select("__key", "term", "wide", "wider").distinct().join(bad.select("__key", F.col("item").alias("term")), ["__key", "term"])
    for name in ("wide", "wider"):
        terms = terms.join(bad.select("__key", F.col("item").alias(name), F.lit(True).alias(f"__{name}")), ["__key", name], "left")
    open_class = lambda c: F.col(c).isNotNull() & F.col(f"__{c}").isNull()
    judged = terms.select("__key", "term", F.when(open_class("wide"), 0).when(open_class("wider"), 1).otherwise(2).alias("verdict"))
    spans = places.join(judged, ["__key", "term"]).groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "verdict"))).alias("__terms"))
    return cut(spans.join(texts.select("__key", "copies"), "__key"))


_TERMS = "array<struct<start:bigint,end:bigint,verdict:int>>"


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Spans of personal data in each row's ``text``.

    Adds n_email, n_ip, n_card, n_phone, n_term, n_removed, base_sha256, spans and terms (start:end:verdict of each term
    span, comma-joined). A null or empty text has no spans; equal texts have equal spans; repeated rows stay repeated and
    count in the statistics as often as they stand there; an empty table gives an empty result; columns other than
    ``keep`` and the text are ignored. Texts are never shuffled: only hashes of terms, summed before the shuffle, and the
    spans of documents that have any. Building the frame runs jobs.
    """
    base = find_base(docs, list(keep))
    without = base.where(F.size("__spans") == 0).select(*keep, "__spans", F.lit(None).cast(_TERMS).alias("__terms"))
    some = base.where(F.size("__spans") > 0).select(*keep, "__key", "__spans")
    joined = heavy_join(some, term_spans(docs, base, threshold), ["__key"], "copies", "left").select(*without.columns)
    every = without.unionByName(joined).withColumn("__terms", F.coalesce("__terms", F.expr(f"cast(array() as {_TERMS})")))
    added = F.transform("__terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end"), F.lit("").alias("value")))
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    verdicts = F.array(*[F.lit(v) for v in VERDICTS])
    return every.select(
        *keep,
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.size("__terms").cast("long").alias("n_term"),
        F.size(F.filter("__terms", lambda t: t["verdict"] == 2)).cast("long").alias("n_removed"),
        F.sha2(_written(F.col("__spans")).cast("binary"), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("__spans", added))).alias("spans"),
        F.array_join(F.transform("__terms", lambda t: F.concat_ws(":", t["start"].cast("string"), t["end"].cast("string"), F.element_at(verdicts, t["verdict"] + 1))), ",").alias("terms"),
    )


def sanitise(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with spans replaced in ``text``: base spans by a label, terms by their class or nothing.

    Spans that overlap become one, under the first one's label. Rows without base spans, and null or empty texts, stay as
    they are; equal texts become equal; repeated rows stay repeated; an empty table stays empty; other columns, whatever
    their names, are carried along. Building the frame runs jobs.
    """
    columns = docs.columns
    terms = term_spans(docs, find_base(docs, []), threshold)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text").alias("__text"), base_spans(F.col("text")).alias("__spans"))
    clean = marked.where(F.size("__spans") == 0).select("__row.*")
    some = heavy_join(marked.where(F.size("__spans") > 0).withColumn("__key", _key(F.col("__text"))), terms, ["__key"], "copies", "left")
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS[:4]])
    text = F.col("__text")

    def replaced(t: Column) -> Column:
        word = F.lower(F.substr(text, (t["start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int")))
        return F.when(t["verdict"] == 0, _class(word, CLASSES[0])).when(t["verdict"] == 1, _class(word, CLASSES[1])).otherwise(F.lit(""))

    pieces = F.concat(
        F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(labels, s["kind"] + 1).alias("label"))),
        F.transform(F.coalesce("__terms", F.expr(f"cast(array() as {_TERMS})")), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), replaced(t).alias("label"))),
    )
    rewritten = F.aggregate(
        F.sort_array(pieces),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["label"]))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))),
    )
    changed = some.withColumn("__new", rewritten)
    changed = changed.select(*[F.col("__new").alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in columns])
    return clean.unionByName(changed)
