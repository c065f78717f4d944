"""Boosts: chunks that a query or its guides name outright go to the front."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOOST_SKIP, CLASS_NOISE, LIMITS
from ..functions import text as X
from ..session import written
from .keyword import light
from .shaping import promote

OVERVIEW = "class_overview"


def exact_identifiers(queries: DataFrame, chunks: DataFrame, sources: tuple[str, ...] = ("api", "guide", "mod")) -> DataFrame:
    """Boosted hits for the classes and methods that a query names: (query_id, chunk_id, rrf_score, ord).

    Source after source: overviews of the class tokens, in order, then up to three methods of each of the first three
    method tokens.
    """
    query = F.col("query")
    classes = F.array_distinct(F.filter(F.regexp_extract_all(query, F.lit(X.CLASS_TOKEN), F.lit(0)), lambda t: (F.length(t) >= 5) & ~F.array_contains(X.literals(BOOST_SKIP), F.lower(t))))
    methods = F.slice(F.array_distinct(F.regexp_extract_all(query, F.lit(X.METHOD_TOKEN), F.lit(0))), 1, LIMITS.method_tokens)
    class_tokens = queries.select("query_id", F.posexplode(classes).alias("no", "class_name"))
    method_tokens = queries.select("query_id", F.posexplode(methods).alias("no", "method_name"))
    place = F.array_position(X.literals(sources), F.col("source")).cast("int")
    rows = chunks.where(F.col("source").isin(*sources)).withColumn("__place", place)
    overviews = rows.where(F.col("type") == OVERVIEW).join(light(class_tokens), "class_name").select("query_id", "chunk_id", "__place", F.lit(0).alias("kind"), "no")
    called = rows.where(F.col("type") == "method").join(light(method_tokens), "method_name")
    called = called.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "source", "no").orderBy("chunk_id"))).where(F.col("__rn") <= LIMITS.method_hits)
    called = called.select("query_id", "chunk_id", "__place", F.lit(1).alias("kind"), "no")
    order = Window.partitionBy("query_id").orderBy("__place", "kind", "no", "chunk_id")
    return overviews.unionByName(called).select("query_id", "chunk_id", F.lit(1.0).alias("rrf_score"), F.row_number().over(order).alias("ord"))


def exact_identifier_boost(hits: DataFrame, queries: DataFrame, chunks: DataFrame, sources: tuple[str, ...] = ("api", "guide", "mod")) -> DataFrame:
    return promote(hits, exact_identifiers(queries, chunks, sources))


def _overviews(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first overview of each (query_id, name): adds chunk_id; homonyms go by least fqn, then id."""
    named = chunks.where((F.col("type") == OVERVIEW) & (F.col("source") == "api")).select("class_name", "fqn", "chunk_id")
    found = named.join(light(written(names)), F.col("name") == F.col("class_name"))
    first = found.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "name").orderBy("fqn", "chunk_id"))).where("__rn = 1")
    return first.drop("__rn", "class_name", "fqn")


def guide_names(guides: DataFrame) -> DataFrame:
    """Class names in a query's first guide hits (query_id, pos, heading, body): (query_id, name, rrf_score, no), ten a query.

    Names with several humps in headings, then names between backticks in headings (score 1), then those in the body's
    first line (0.85); each once.
    """
    top = guides.where(F.col("pos") < LIMITS.bridge_hits)
    skip = X.literals(BOOST_SKIP)
    heading, line = F.coalesce("heading", F.lit("")), F.substring_index(F.coalesce("body", F.lit("")), "\n", 1)
    humped = F.filter(F.regexp_extract_all(heading, F.lit(X.HUMPED_NAME), F.lit(1)), lambda x: (F.length(x) >= 6) & ~F.array_contains(skip, F.lower(x)))
    ticked = lambda t, n: F.filter(F.transform(F.regexp_extract_all(t, F.lit(X.TICKED_NAME), F.lit(1)), X.last_segment), lambda x: F.length(x) >= n)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.lit(1.0).alias("score"), F.concat(humped, ticked(heading, 4)).alias("names")), F.struct(F.lit(1).alias("kind"), F.lit(0.85).alias("score"), ticked(line, 6).alias("names")))
    named = top.select("query_id", "pos", F.explode(kinds).alias("k")).select("query_id", "pos", "k.kind", "k.score", F.posexplode("k.names").alias("i", "name"))
    once = named.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "name").orderBy("kind", "pos", "i"))).where("__rn = 1")
    numbered = once.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "pos", "i")))
    return numbered.where(F.col("no") <= LIMITS.bridge_names).select("query_id", "name", F.col("score").alias("rrf_score"), "no")


def guide_bridge_boost(api_hits: DataFrame, guides: DataFrame, chunks: DataFrame) -> DataFrame:
    """API hits with the classes that the guides name put first."""
    return promote(api_hits, _overviews(guide_names(guides), chunks).select("query_id", "chunk_id", "rrf_score", F.col("no").alias("ord")))


def overlapping_names(queries: DataFrame, names: DataFrame, n: int = LIMITS.overlap_names) -> DataFrame:
    """(query_id, name, score, no): the names (ord, name, stems) that share most stems with a query's stems.

    ``queries`` has query_id and stems. Two shared stems or more score shared / size; one counts only for a name of at
    most two stems, if it has five letters and at most four names have it. Queries need two stems.
    """
    asked = queries.where(F.size("stems") >= 2)
    rarity = names.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    spread = names.select("ord", "name", F.size("stems").alias("size"), F.explode("stems").alias("stem")).join(rarity, "stem")
    words = asked.select("query_id", F.explode("stems").alias("stem"))
    met = words.join(spread, "stem").groupBy("query_id", "ord", "name", "size").agg(F.count(F.lit(1)).alias("shared"), F.max(F.struct("stem", "df")).alias("one"))
    single = (F.col("shared") == 1) & (F.col("size") <= 2) & (F.length("one.stem") >= 5) & (F.col("one.df") <= 4)
    scored = met.where((F.col("shared") >= 2) | single).withColumn("score", F.col("shared") / F.col("size"))
    ranked = scored.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord"))))
    return ranked.where(F.col("no") <= n).select("query_id", "name", "score", "no")


def description_names(descriptions: DataFrame) -> DataFrame:
    """(ord, name, stems) of a description table (ord, fqn)."""
    name = X.last_segment(F.col("fqn"))
    return descriptions.select("ord", name.alias("name"), X.class_stems(name, CLASS_NOISE).alias("stems")).where(F.size("stems") > 0)


def class_name_boost(api_hits: DataFrame, queries: DataFrame, descriptions: DataFrame, chunks: DataFrame) -> DataFrame:
    """API hits with the described classes first whose names share stems with the query."""
    asked = queries.select("query_id", X.query_stems(F.col("query"), CLASS_NOISE).alias("stems"))
    best = overlapping_names(asked, description_names(descriptions))
    found = _overviews(best, chunks).select("query_id", "chunk_id", F.lit(1.0).alias("rrf_score"), F.col("no").alias("ord"))
    return promote(api_hits, found)
