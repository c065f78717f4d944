"""Search pipelines over collections, composed of the ranking operators, and renderers of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import text as X
from ..operators import boosts, fusion, keyword, shaping
from ..session import written

SOURCES = ("api", "guide", "mod")


class Search:
    """One engine over chunks, their keyword index, optional dense hits and a description table.

    ``dense(queries, n, known)`` returns (query_id, source, chunk_id, pos), the n nearest of each source, of the ``known`` ids
    alone if they are given; without it keyword search stands alone. Without a stored ``index`` the keyword index is computed from the chunks in each search.
    """

    def __init__(self, chunks: DataFrame, dense=None, descriptions: DataFrame | None = None, index: keyword.Index | None = None, parser=keyword.parse, dense_fetch: int = LIMITS.least_fetch):
        self.dense_fetch = dense_fetch
        self.chunks, self.dense, self.descriptions, self.parser = chunks, dense, descriptions, parser
        self.index = index or keyword.Index.of(chunks)

    def hybrid(self, queries: DataFrame, fetch: dict[str, int], where=None) -> DataFrame:
        """Fused hits of some sources, ``fetch`` of each, in one plan over one reading of the postings; written once, as small as
        the queries. A filter holds for both legs; keyword statistics stay those of the whole source."""
        sources = list(fetch)
        part = F.lit(0)
        for source, n in fetch.items():
            part = F.when(F.col("source") == source, F.lit(n)).otherwise(part)
        known = None if where is None else self.chunks.where(F.col("source").isin(*sources) & where)
        words = keyword.keyword_search(self.index.only(*sources), queries, LIMITS.keyword_fetch * max(fetch.values()), self.parser, known).where(F.col("pos") < LIMITS.keyword_fetch * part)
        if self.dense is None:
            near = queries.select("query_id", F.lit("").alias("source"), F.lit("").alias("chunk_id"), F.lit(0).alias("pos")).where(F.lit(False))
        else:
            near = self.dense(queries, self.dense_fetch, known).where(F.col("source").isin(*sources))
        return written(fusion.fuse(near, fusion.gate(words, near, queries), part, self.chunks if self.dense is not None else None))

    def _described(self, hits: DataFrame) -> DataFrame:
        """Hits with the columns that shaping needs; bodies are joined after the last cut."""
        hits = written(hits.drop("source"))
        return self._rows(hits, "source", "fqn")

    def _rows(self, hits: DataFrame, *columns: str) -> DataFrame:
        """Written hits, as few as the queries ask for, with columns of their chunks; other chunks are not moved."""
        some = self.chunks.select("chunk_id", *columns).join(keyword.light(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
        return hits.join(some, "chunk_id")

    def _leg(self, hits: DataFrame, source: str) -> DataFrame:
        return hits.where(F.col("source") == source).drop("source")

    def docs(self, queries: DataFrame, limit: int = 8) -> DataFrame:
        """All sources: hybrid each, guide bridge, class names, exact identifiers, re-rank, two a class, quotas."""
        fetch = max(LIMITS.least_fetch, 3 * limit)
        every = self.hybrid(queries, {s: fetch // k for s, k in zip(SOURCES, (2, 3, 4), strict=True)})
        api, guide, mod = (self._leg(every, s) for s in SOURCES)
        bodies = self._rows(guide, "heading", "body")
        api = boosts.guide_bridge_boost(api, bodies, self.chunks)
        if self.descriptions is not None:
            api = boosts.class_name_boost(api, queries, self.descriptions, self.chunks)
        every = None
        for i, part in enumerate((api, guide, mod)):
            part = part.select("query_id", "chunk_id", "rrf_score", F.lit(i).alias("__leg"), "pos")
            every = part if every is None else every.unionByName(part)
        hits = shaping.renumber(every, "__leg", "pos").drop("__leg")
        hits = boosts.exact_identifier_boost(hits, queries, self.chunks)
        hits = shaping.first_per_key(shaping.rerank(self._described(hits)))
        return shaping.with_slots(hits, limit)

    def single(self, queries: DataFrame, source: str, limit: int = 8, package: str = "", kind: str = "") -> DataFrame:
        """One source; for the API with package and type filters, class names and two a class."""
        fetch = max(LIMITS.least_fetch, 3 * limit)
        where = None
        if package or kind:
            where = (F.coalesce("package", F.lit("")).startswith(package)) & ((F.col("type") == kind) if kind else F.lit(True))
        hits = self._leg(self.hybrid(queries, {source: fetch}, where), source)
        scope = self.chunks if where is None else self.chunks.where(where)
        hits = boosts.exact_identifier_boost(hits, queries, scope, (source,))
        if source == "api":
            if self.descriptions is not None:
                hits = boosts.class_name_boost(hits, queries, self.descriptions, scope)
            hits = shaping.first_per_key(self._described(hits))
            return shaping.cut(shaping.renumber(hits, "pos"), limit)
        return shaping.cut(self._described(hits), limit)

    def dashboard(self, queries: DataFrame, source: str = "all", limit: int = 8, package: str = "") -> DataFrame:
        """The dashboard's variant: an even fetch a source, no bridge and no class names, quotas only over all sources."""
        sources = SOURCES if source == "all" else (source,)
        fetch = max(LIMITS.least_fetch, 3 * limit)
        every = self.hybrid(queries, dict.fromkeys(sources, fetch // len(sources)))
        every = every.withColumn("__leg", F.array_position(X.literals(sources), F.col("source")))
        hits = boosts.exact_identifier_boost(shaping.renumber(every, "__leg", "pos").drop("__leg", "source"), queries, self.chunks, sources)
        hits = shaping.first_per_key(shaping.rerank(self._described(hits)))
        if package:
            named = self.chunks.where(F.coalesce("package", F.lit("")).contains(package)).select("chunk_id")
            hits = hits.join(named, "chunk_id", "left_semi")
        hits = shaping.renumber(hits, "pos")
        return shaping.with_slots(hits, limit) if source == "all" else shaping.cut(hits, limit)


def rendered(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, text): results of each query as text, in order. Chunks whose body is missing are shown without one."""
    rows = hits.select("query_id", "pos", "chunk_id", "rrf_score").join(chunks, "chunk_id")
    place = F.concat_ws(" | ", F.concat(F.lit("["), F.upper("source"), F.lit("]")), F.nullif(F.coalesce("fqn", "title", F.lit("")), F.lit("")), F.nullif(F.coalesce("heading", "file", F.lit("")), F.lit("")), F.format_string("score %.4f", F.col("rrf_score")))
    block = F.concat(F.lit("**Result "), (F.col("pos") + 1).cast("string"), F.lit("** "), place, F.lit("\n"), F.coalesce("body", F.lit("")))
    grouped = rows.select("query_id", "pos", block.alias("block")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("blocks"))
    return grouped.select("query_id", F.concat_ws("\n\n", F.col("blocks.block")).alias("text"))


def as_json(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, pos, json): each result as an object, the text cut at 500 characters, the score at four digits.

    Hits with a dense ``distance`` carry a similarity, 1 - distance, at three digits.
    """
    near = (1 - F.col("distance")) if "distance" in hits.columns else F.lit(None).cast("double")
    rows = hits.select("query_id", "pos", "chunk_id", "rrf_score", near.alias("similarity")).join(chunks, "chunk_id")
    item = F.struct(F.col("chunk_id").alias("id"), "source", F.round("rrf_score", 4).alias("score"), F.round(F.col("similarity"), 3).alias("similarity"), X.shortened(F.coalesce("body", F.lit("")), LIMITS.text_chars).alias("text"))
    return rows.select("query_id", "pos", F.to_json(item).alias("json"))
