"""Keyword ranking: query parsing, postings, and BM25 over phrases.

All operators take batches: a query is a row (query_id, query), a hit a row with its position ``pos`` from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import text as X
from ..functions.porter import analysed
from ..session import ship

#: Up to so many query terms (counted first) are broadcast to the postings; beyond, both sides are dealt out by term.
BROADCAST_TERMS = 200_000
#: Up to so many phrases of all queries are held by the driver, as a table of its own.
FEW_PHRASES = 10_000
#: Up to so many distinct terms are a condition on the stored postings; parts that a common term is dealt out over.
FEW_TERMS, TERM_PARTS = 1_000, 64


def parse(queries: DataFrame) -> DataFrame:
    """Phrases of each query: (query_id, phrase_no, phrase), in order; words and their humps are alternatives alike."""
    words = queries.select("query_id", F.flatten(F.transform(X.query_words(F.col("query")), X.query_parts)).alias("p"))
    return words.select("query_id", F.posexplode("p").alias("phrase_no", "phrase"))


def plain_phrases(queries: DataFrame) -> DataFrame:
    """Every token of a query as a phrase of its own; a repeated one counts again."""
    return queries.select("query_id", F.posexplode(X.tokens(F.col("query"))).alias("phrase_no", "phrase"))


def whole_phrases(queries: DataFrame) -> DataFrame:
    """The words of a query as they are, without their humps."""
    return queries.select("query_id", F.posexplode(X.query_words(F.col("query"))).alias("phrase_no", "phrase"))


def _analyse(words: DataFrame, column: str, analyzer: str) -> DataFrame:
    """Terms of a column of words: as they are, or folded and stemmed through their distinct vocabulary."""
    if analyzer == "plain":
        return words.withColumn("term", F.col(column))
    ship(words.sparkSession)
    vocabulary = words.select(column).distinct().withColumn("term", analysed(F.col(column)))
    return words.join(vocabulary, column)


def _field_tokens(chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(chunk_id, length, parts): the tokens of each field, and their number over all fields, in one pass over the text."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), X.tokens(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f in fields])
    source = F.col("source") if "source" in chunks.columns else F.lit("")
    return chunks.select(source.alias("source"), "chunk_id", parts.alias("parts")).withColumn("length", F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["words"])))


def term_counts(chunks: DataFrame, field: str = "body") -> DataFrame:
    """(term, df, cf): chunks that have each term, and how often. Words are sorted within their chunk, so that each chunk's
    first of a term is known in its row and one exchange of summed counts is all."""
    rows = chunks.select(F.array_sort(X.tokens(F.coalesce(F.col(field), F.lit("")))).alias("w"))
    first = lambda w, i: (i == 0) | (F.element_at(F.col("w"), F.greatest(i, F.lit(1))) != w)
    words = rows.select(F.explode(F.transform("w", lambda w, i: F.struct(w.alias("term"), first(w, i).cast("int").alias("first")))).alias("x"))
    return words.select("x.*").groupBy("term").agg(F.sum("first").cast("long").alias("df"), F.count(F.lit(1)).alias("cf"))


def postings(chunks: DataFrame, fields: tuple[str, ...] = ("body",), analyzer: str = "plain") -> DataFrame:
    """(source, chunk_id, length, field, position, term): each token of the fields. Positions count from 0 in each field."""
    words = _field_tokens(chunks, fields).select("source", "chunk_id", "length", F.explode("parts").alias("x")).select("source", "chunk_id", "length", "x.field", F.posexplode("x.words").alias("position", "word"))
    return _analyse(words, "word", analyzer).select("source", "chunk_id", "length", "field", "position", "term")


@dataclass
class Index:
    """An inverted index: a row for each token, and for each source its number of chunks and their mean length."""

    postings: DataFrame
    stats: DataFrame
    analyzer: str = "plain"

    @classmethod
    def of(cls, chunks: DataFrame, fields: tuple[str, ...] = ("body",), analyzer: str = "plain") -> Index:
        """An index that is computed whenever it is read."""
        stats = _field_tokens(chunks, fields).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("average"))
        return cls(postings(chunks, fields, analyzer), stats, analyzer)

    def write(self, path: str) -> Index:
        """Store the index. Tokens lie sorted by term, dealt out by term and chunk, so a common term is in many files and a
        query reads the row groups of its terms alone."""
        spark = self.postings.sparkSession
        dealt = self.postings.repartition("term", F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_PARTS)))
        dealt.sortWithinPartitions("term", "source", "chunk_id", "field", "position").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return Index.read(spark, path, self.analyzer)

    def only(self, *sources: str) -> Index:
        """The part of some sources."""
        return Index(self.postings.where(F.col("source").isin(*sources)), self.stats, self.analyzer)

    @classmethod
    def read(cls, spark: SparkSession, path: str, analyzer: str = "plain") -> Index:
        """A stored index; new batches of a stream may have been added to it."""
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), analyzer)


def _score(frequency: Column, length: Column, average: Column, matching: Column, count: Column) -> Column:
    idf = F.log((count - matching + 0.5) / (matching + 0.5))
    idf = F.when(idf <= 0, F.lit(LIMITS.least_idf)).otherwise(idf)
    return idf * frequency * (LIMITS.k1 + 1) / (frequency + LIMITS.k1 * (1 - LIMITS.b + LIMITS.b * length / average))


def light(frame: DataFrame) -> DataFrame:
    """A query-side frame, marked for broadcast if a count shows that it is small; else it is joined like any other."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_TERMS else frame


def bm25(index: Index, phrases: DataFrame) -> DataFrame:
    """(query_id, source, chunk_id, score) of every chunk that has one of a query's phrases; statistics are each source's.

    A phrase of several tokens matches where they follow one another in one field. Only tokens that a query has leave the
    scan: few terms are a condition on the sorted files, more are broadcast, and beyond BROADCAST_TERMS joined. What is
    joined to frequencies afterwards is as small as the queries, so no posting list meets in one task. Building the frame
    counts and, where they are few, collects the query terms.
    """
    distinct = phrases.select("phrase").distinct().withColumn("parts", X.tokens(F.col("phrase"))).where(F.size("parts") > 0)
    pieces = distinct.select("phrase", F.size("parts").alias("n"), F.posexplode("parts").alias("offset", "word"))
    pieces = _analyse(pieces, "word", index.analyzer).select("phrase", "n", "offset", "term")
    terms = [r["term"] for r in pieces.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    rows = index.postings.where(F.col("term").isin(terms)) if len(terms) <= FEW_TERMS else index.postings
    found = rows.join(light(pieces), "term")
    key = ["phrase", "source", "chunk_id", "length"]
    single = found.where("n = 1").groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("f"))
    runs = found.where("n > 1").groupBy(*key, "n", "field", (F.col("position") - F.col("offset")).alias("at")).agg(F.count(F.lit(1)).alias("got")).where("got = n")
    frequency = single.unionByName(runs.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("f")))
    matching = frequency.groupBy("source", "phrase").agg(F.count(F.lit(1)).cast("double").alias("matching")).join(F.broadcast(index.stats), "source")
    wanted = phrases.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).cast("double").alias("times"))
    small = F.broadcast if wanted.count() <= BROADCAST_TERMS else (lambda x: x)
    scored = frequency.join(small(matching), ["source", "phrase"]).withColumn("value", _score(F.col("f"), F.col("length"), F.col("average"), F.col("matching"), F.col("n")))
    return scored.join(small(wanted), "phrase").groupBy("query_id", "source", "chunk_id").agg(F.sum(F.col("value") * F.col("times")).alias("score"))


def top(scored: DataFrame, n: int | Column, *order: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first n rows of each query, with ``pos`` from 0; Spark prunes to n a partition before the shuffle."""
    ranked = scored.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("pos") <= n).withColumn("pos", F.col("pos") - 1)


def keyword_search(index: Index, queries: DataFrame, n: int = 30, parser=parse, known: DataFrame | None = None) -> DataFrame:
    """(query_id, source, chunk_id, score, pos): the n best chunks of each query and source; ties by chunk_id.

    With ``known`` ids only those are ranked; statistics stay those of the whole source. A stored index of blocks skips what
    cannot be among the best.
    """
    if hasattr(index, "ranked"):
        return index.ranked(parser(queries), n, known)
    scored = bm25(index, parser(queries)).withColumn("score", F.round("score", 9))
    scored = scored if known is None else scored.join(known.select("chunk_id"), "chunk_id", "left_semi")
    return top(scored, n, F.desc("score"), F.asc("chunk_id"), by=("query_id", "source"))
