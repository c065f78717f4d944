"""All queries of the engine by name over the driver's tables, and equivalent DuckDB SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, boosts, code, dense, diff, fusion, grams, graph, keyword, shaping, vector_index
from ..operators.dense import vector_search as dense_search
from ..session import shared, spread
from ..sources import store
from . import catalog_sql, literals
from .search import Search, as_json, rendered


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a local relation, which the optimiser can fold."""
    names = [column.split()[0] for column in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}), schema)


def _queries(spark: SparkSession) -> DataFrame:
    return _frame(spark, literals.QUERIES, "query_id int, query string")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as API chunks: the first capitalised word of five letters or more is the class name."""
    empty = F.lit(None).cast("string")
    return spread(_table(spark, folder, "documents")).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), F.lit("api").alias("source"), F.lit("class_overview").alias("type"), F.concat_ws(".", "source", "lang").alias("fqn"),
        F.regexp_extract("text", r"[A-Z][a-z]{4,}", 0).alias("class_name"), empty.alias("method_name"), F.col("source").alias("package"), empty.alias("heading"), F.col("text").alias("body"),
    )


def all_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, pages and conversations as the three sources."""
    empty = F.lit(None).cast("string")
    pages = _table(spark, folder, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("chunk_id"), F.lit("guide").alias("source"), F.lit("guide").alias("type"), F.lit("").alias("fqn"),
        empty.alias("class_name"), empty.alias("method_name"), empty.alias("package"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.col("html").alias("body"),
    )
    talks = _table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("chunk_id"), F.lit("mod").alias("source"), F.lit("mod").alias("type"), F.concat(F.lit("talk"), F.col("conv_id")).alias("fqn"),
        empty.alias("class_name"), empty.alias("method_name"), empty.alias("package"), empty.alias("heading"), F.col("text").alias("body"),
    )
    return document_chunks(spark, folder).unionByName(pages).unionByName(talks)


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, queries): every row whose id is divisible by 50 is a query against all rows."""
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return rows, rows.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("rrf_score", 9).alias("score"), F.col("pos").cast("int").alias("pos"))


_WRITTEN: dict[tuple[str, str], str] = {}


def _stored_at(spark: SparkSession, folder: str, kind: str, about: tuple, tables: tuple[str, ...]) -> tuple[tuple[str, str], str]:
    """(key, path) of something stored for tables of a folder; other files, sizes or times of the tables make another one."""
    seen = []
    for name in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        seen.append(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, hashlib.md5(repr((folder, kind, about, seen)).encode()).hexdigest())
    return key, f"{shared(spark).rstrip('/')}/{kind}-{'-'.join(key)}"


def stored_index(spark: SparkSession, folder: str, fields: tuple[str, ...] = ("body",)) -> blocks.BlockIndex:
    """The index of all chunks of a folder, written to the shared folder once a session and read by every query after."""
    key, path = _stored_at(spark, folder, "index", fields, ("documents", "pages", "conversations"))
    if key not in _WRITTEN:
        blocks.BlockIndex.write(all_chunks(spark, folder), path, fields)
        _WRITTEN[key] = path
    return blocks.BlockIndex.read(spark, _WRITTEN[key])


def _keyword(spark, folder, queries, n, fields=("body",), **options):
    return keyword.keyword_search(stored_index(spark, folder, fields).only("api"), queries, n, **options)


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("pos").cast("int").alias("pos"))


def bm25_topk(spark, folder):
    return _scored(_keyword(spark, folder, _queries(spark), 10))


def bm25_batch_queries(spark, folder):
    asked = _table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _scored(_keyword(spark, folder, asked, 5, parser=keyword.plain_phrases))


def bm25_fields(spark, folder):
    """Keyword ranking over several fields."""
    return _scored(_keyword(spark, folder, _frame(spark, literals.FIELD_QUERIES, "query_id int, query string"), 10, ("fqn", "class_name", "body"), parser=keyword.plain_phrases))


def phrase_topk(spark, folder):
    return _scored(_keyword(spark, folder, _frame(spark, literals.PHRASES, "query_id int, query string"), 10, parser=keyword.whole_phrases))


def index_build(spark, folder):
    """Tokens, distinct terms and statistics of the stored index, by source."""
    index = stored_index(spark, folder)
    terms = index.blocks.groupBy("source").agg(F.sum("total").alias("tokens"), F.countDistinct("term").alias("terms"))
    return terms.join(F.broadcast(index.stats), "source").select("source", "tokens", "terms", F.col("chunks").cast("long").alias("chunks"), F.round("average", 6).alias("average"))


def porter_terms(spark, folder):
    """Stems of the vocabulary of all documents."""
    from ..functions.porter import analysed
    from ..session import ship

    ship(spark)
    words = spread(_table(spark, folder, "documents")).select(F.explode(F.array_distinct(X.tokens(F.coalesce("text", F.lit(""))))).alias("word"))
    return words.distinct().select("word", analysed(F.col("word")).alias("stem"))


def query_parse_terms(spark, folder):
    """Phrases of all benchmark texts, taken as queries."""
    return keyword.parse(_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def mini_stem_df(spark, folder):
    words = spread(_table(spark, folder, "documents")).select("doc_id", F.explode(F.array_distinct(F.transform(X.tokens(F.col("text")), X.stem))).alias("stem"))
    return words.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))


def postings_stats(spark, folder):
    """Document and corpus frequency of each term of the inverted index."""
    return keyword.term_counts(document_chunks(spark, folder))


def vector_topk(spark, folder):
    rows, asked = _vectors(spark, folder)
    hits = dense.vector_search(rows, asked, 10)
    return hits.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("pos").cast("int").alias("pos"))


def stored_vectors(spark: SparkSession, folder: str) -> vector_index.VectorIndex:
    """The inverted lists of a folder's embeddings, written to the shared folder once a session."""
    key, path = _stored_at(spark, folder, "vectors", (), ("embeddings",))
    if key not in _WRITTEN:
        vector_index.VectorIndex.write(_vectors(spark, folder)[0], path)
        _WRITTEN[key] = path
    return vector_index.VectorIndex.read(spark, _WRITTEN[key])


def vector_index_topk(spark, folder):
    """The exact nearest rows by the stored lists, without the lists that their bounds rule out."""
    hits = stored_vectors(spark, folder).search(_vectors(spark, folder)[1], 10, exact=True)
    return hits.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("pos").cast("int").alias("pos"))


def vector_index_recall(spark, folder):
    """The share of each query's exact neighbours that the probed lists give."""
    rows, asked = _vectors(spark, folder)
    exact = dense.vector_search(rows, asked, 10).select("query_id", "chunk_id")
    found = dense.recall_at(stored_vectors(spark, folder).search(asked, 10), exact, 10)
    return found.select("query_id", F.round("recall", 6).alias("recall"))


def vector_topk_filtered(spark, folder):
    rows, asked = _vectors(spark, folder)
    hits = dense.vector_search(rows, asked, 5, F.col("label") == 3)
    return hits.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("pos").cast("int").alias("pos"))


def recall_at_k(spark, folder):
    rows, asked = _vectors(spark, folder)
    labels = rows.select("chunk_id", F.col("label").alias("group"))
    grouped = labels.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "group")
    found = dense.recall_of_groups(dense.vector_search(rows, asked, 10), labels, grouped, 10)
    return found.select("query_id", F.round("recall", 6).alias("recall"))


def prefix_filter(spark, folder):
    return store.get(_table(spark, folder, "part"), prefix={"p_type": "S", "p_name": "red "}).select("p_partkey", "p_name", "p_type")


def rrf_fusion(spark, folder):
    asked = _queries(spark)
    graded = _table(spark, folder, "labels").join(_table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    best = graded.orderBy(F.desc("quality"), F.desc("n_chars"), "doc_id").limit(30).select(F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), "quality", "n_chars", "doc_id").collect()
    near = _for_each(asked, [(r["chunk_id"], i) for i, r in enumerate(sorted(best, key=lambda r: (-r["quality"], -r["n_chars"], r["doc_id"])))])
    return _ranked(fusion.fuse(near.withColumn("source", F.lit("api")), _keyword(spark, folder, asked, 30), 10, document_chunks(spark, folder)))


def _for_each(asked: DataFrame, hits: list[tuple[str, int]]) -> DataFrame:
    """The same few hits for each query."""
    rows = F.array(*[F.struct(F.lit(c).alias("chunk_id"), F.lit(p).alias("pos")) for c, p in hits])
    return asked.select("query_id", F.explode(rows).alias("h")).select("query_id", "h.*")


def identifier_gate(spark, folder):
    docs = _table(spark, folder, "documents")
    return docs.groupBy("lang").agg(F.count(F.when(X.names_identifier(F.col("text")), 1)).alias("named"), F.count(F.lit(1)).alias("total"))


def _by_length(spark, folder) -> DataFrame:
    docs = _table(spark, folder, "documents").select(F.col("source").alias("query_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), "lang", "n_chars", "doc_id")
    return shaping.renumber(docs, F.desc("n_chars"), F.asc("doc_id"))


def dedup_per_key(spark, folder):
    keyed = _by_length(spark, folder).withColumn("fqn", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")))
    return shaping.first_per_key(keyed).select("query_id", "chunk_id", F.col("pos").cast("int").alias("pos"))


def source_slots(spark, folder):
    source = F.when(F.col("lang") == "en", "api").when(F.col("lang") == "fr", "guide").when(F.col("lang") == "de", "mod").otherwise("other")
    return shaping.with_slots(_by_length(spark, folder).withColumn("source", source), 8).select("query_id", "chunk_id", F.col("pos").cast("int").alias("pos"))


def exact_boost(spark, folder):
    chunks, asked = document_chunks(spark, folder), _queries(spark)
    hits = fusion.fuse(_none(asked), _keyword(spark, folder, asked, 30), 10).drop("source")
    return _ranked(boosts.exact_identifier_boost(hits, asked, chunks, ("api",)))


def _none(asked: DataFrame) -> DataFrame:
    return asked.where(F.lit(False)).select("query_id", F.lit("").alias("source"), F.lit("").alias("chunk_id"), F.lit(0).alias("pos"))


def token_overlap_boost(spark, folder):
    words = lambda c: F.array_distinct(F.transform(F.split(F.lower(c), " "), X.stem))
    names = _table(spark, folder, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord")).withColumn("stems", words(F.col("name")))
    asked = _frame(spark, literals.OVERLAPS, "query_id int, query string").select("query_id", words(F.col("query")).alias("stems"))
    return boosts.overlapping_names(asked, names).select("query_id", "name", F.round("score", 6).alias("score"), F.col("no").cast("int").alias("no"))


def bridge_boost(spark, folder):
    word = F.regexp_extract("html", "<h1>([A-Z][a-z]{4,})", 1)
    guides = _table(spark, folder, "pages").select((F.col("page_id") % 7).cast("int").alias("query_id"), "page_id", F.when(word != "", F.concat(F.lit("About `"), word, F.lit("`"))).alias("heading"), F.col("html").alias("body"))
    guides = shaping.renumber(guides, F.asc("page_id"))
    chunks = document_chunks(spark, folder)
    start = [(r["chunk_id"], i) for i, r in enumerate(chunks.select("chunk_id").orderBy("chunk_id").limit(5).collect())]
    hits = _for_each(guides.select("query_id").distinct(), start).withColumn("rrf_score", F.lit(0.01))
    return _ranked(boosts.guide_bridge_boost(hits, guides, chunks))


def _engine(spark, folder, **options) -> Search:
    return Search(all_chunks(spark, folder), index=stored_index(spark, folder), **options)


def _dense(spark, folder):
    """Dense hits by the embeddings table: query i asks with vector i; vectors stand for documents and for pages."""
    rows = _table(spark, folder, "embeddings").select("vec_id", "embedding")

    def dense(queries: DataFrame, n: int, known: DataFrame | None) -> DataFrame:
        asked = rows.join(keyword.light(queries.select("query_id")), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("vector"))
        found = None
        for source, mark in (("api", "d"), ("guide", "p")):
            held = rows.withColumn("chunk_id", F.concat(F.lit(mark), F.col("vec_id")))
            held = held if known is None else held.join(known.select("chunk_id"), "chunk_id", "left_semi")
            hits = dense_search(held.select("chunk_id", "embedding"), asked, n).select("query_id", F.lit(source).alias("source"), "chunk_id", "pos")
            found = hits if found is None else found.unionByName(hits)
        return found

    return dense


def _hybrid_engine(spark, folder) -> Search:
    return _engine(spark, folder, dense=_dense(spark, folder), descriptions=_frame(spark, literals.DESCRIPTIONS, "ord int, fqn string"))


def search_all_pipeline(spark, folder):
    return _ranked(_engine(spark, folder).docs(_queries(spark)))


def search_single_pipeline(spark, folder):
    return _ranked(_engine(spark, folder).single(_queries(spark), "api", package="src1"))


def search_guides_pipeline(spark, folder):
    return _ranked(_engine(spark, folder).single(_queries(spark), "guide"))


def search_mods_pipeline(spark, folder):
    return _ranked(_engine(spark, folder).single(_queries(spark), "mod"))


def search_api_by_type(spark, folder):
    """The API pipeline with a type filter that leaves nothing out, and one that leaves out all."""
    engine, asked = _engine(spark, folder), _queries(spark)
    both = [engine.single(asked, "api", kind=k).select("query_id", "chunk_id", "rrf_score", "pos", F.lit(k).alias("kind")) for k in ("class_overview", "method")]
    return both[0].unionByName(both[1]).select("kind", "query_id", "chunk_id", F.round("rrf_score", 9).alias("score"), F.col("pos").cast("int").alias("pos"))


def dashboard_search(spark, folder):
    return _ranked(_engine(spark, folder).dashboard(_queries(spark)))


def dashboard_guides(spark, folder):
    return _ranked(_engine(spark, folder).dashboard(_queries(spark), "guide"))


def dashboard_package(spark, folder):
    return _ranked(_engine(spark, folder).dashboard(_queries(spark), "api", package="rc1"))


def hybrid_all_pipeline(spark, folder):
    """All sources with dense hits and described class names."""
    return _ranked(_hybrid_engine(spark, folder).docs(_queries(spark)))


def hybrid_api_pipeline(spark, folder):
    return _ranked(_hybrid_engine(spark, folder).single(_queries(spark), "api"))


def hybrid_guides_pipeline(spark, folder):
    return _ranked(_hybrid_engine(spark, folder).single(_queries(spark), "guide"))


def hybrid_dashboard(spark, folder):
    """The dashboard's search over all sources with dense hits."""
    return _ranked(_hybrid_engine(spark, folder).dashboard(_queries(spark)))


def chunk_bodies(spark, folder):
    """Documents with their bodies from a store that has lost every third."""
    docs = _table(spark, folder, "documents").withColumn("chunk_id", F.concat(F.lit("d"), F.col("doc_id")))
    found = store.with_bodies(docs.select("chunk_id", "source"), docs.where(F.col("doc_id") % 3 != 0).select("chunk_id", F.col("text").alias("body")))
    return found.select("chunk_id", "source", F.length("body").cast("long").alias("size"), F.md5("body").alias("digest"))


def rendered_results(spark, folder):
    """Results of the guides' pipeline as text."""
    engine = _engine(spark, folder)
    chunks = engine.chunks.withColumns({"title": F.lit(None).cast("string"), "file": F.lit(None).cast("string")})
    return rendered(engine.single(_queries(spark), "guide", 2), chunks)


def json_results(spark, folder):
    """Results of the mods' pipeline as objects."""
    engine = _engine(spark, folder)
    rows = as_json(engine.single(_queries(spark), "mod", 3), engine.chunks)
    return rows.select("query_id", F.col("pos").cast("int").alias("pos"), *[F.get_json_object("json", f"$.{k}").alias(k) for k in ("id", "source", "text")])


def index_fallback(spark, folder):
    """Keyword hits with their rows, where the store has lost every other document: those take the index's own columns."""
    chunks = document_chunks(spark, folder)
    left = chunks.where(F.substring("chunk_id", 2, 20).cast("long") % 2 == 0)
    hits = _keyword(spark, folder, _queries(spark), 10).select("query_id", "chunk_id", "pos")
    found = fusion.with_rows(hits, left.withColumn("class_name", F.lit("stored")), chunks)
    return found.select("query_id", "chunk_id", F.col("pos").cast("int").alias("pos"), "fqn", "class_name", F.length("body").alias("size"), "from_index")


def package_rollup(spark, folder):
    found = graph.packages(_table(spark, folder, "part").select(F.col("p_brand").alias("package"), F.col("p_name").alias("class_name")))
    return found.select("package", "classes", F.concat_ws(",", "shown").alias("shown"), "more")


def _nations(spark, folder) -> DataFrame:
    regions = _table(spark, folder, "region")
    rows = _table(spark, folder, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.lit("api").alias("source"), F.lit("class_overview").alias("type"), F.col("n_name").alias("class_name"), F.concat_ws(".", "r_name", "n_name").alias("fqn"), F.col("r_name").alias("extends"), F.concat(F.col("r_name"), F.lit(" , I"), (F.col("n_nationkey") % 3).cast("string")).alias("implements"))


def subclass_lookup(spark, folder):
    names = _table(spark, folder, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("name"))
    return graph.subclasses(_nations(spark, folder), names).select("query_id", "total", F.concat_ws(",", "shown").alias("shown"))


def implementors(spark, folder):
    names = _frame(spark, [(0, "I0"), (1, "I1"), (2, "I2"), (3, "ASIA")], "query_id int, name string")
    return graph.implementors(_nations(spark, folder), names).select("query_id", "total", F.concat_ws(",", "shown").alias("shown"))


def recursive_ancestors(spark, folder):
    name = lambda n: F.concat_ws("_", "conv_id", n)
    turns = _table(spark, folder, "conversations").select(name(F.col("turn")).alias("name"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).otherwise("").alias("parent"), "turn")
    starts = turns.where(F.col("turn") == 7).select(F.col("name").alias("query_id"), "name")
    return graph.ancestors(turns, starts).select("query_id", "depth", "name")


def package_totals(spark, folder):
    return graph.package_totals(graph.packages(_table(spark, folder, "part").select(F.col("p_brand").alias("package"), F.col("p_name").alias("class_name"))))


def class_chunks(spark, folder) -> DataFrame:
    """A class corpus: regions, nations that extend them, suppliers that extend nations; customers and regions' markets are methods."""
    regions, nations = _table(spark, folder, "region"), _table(spark, folder, "nation")
    placed = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")

    def overviews(rows, name, package, up, interfaces):
        fqn = F.concat_ws(".", package, name)
        return rows.select(F.concat(F.lit("c:"), fqn).alias("chunk_id"), F.lit("class_overview").alias("type"), fqn.alias("fqn"), name.alias("class_name"), none.alias("method_name"), package.alias("package"), F.lit("public").alias("visibility"), up.alias("extends"), interfaces.alias("implements"), F.concat(F.lit("class "), name, F.lit("\n// Fields:\nint "), F.lower(name), F.lit(";\n")).alias("body"))

    def methods(rows, owner, package, name, number):
        fqn = F.concat_ws(".", package, owner)
        kind = F.element_at(F.array(F.lit("public"), F.lit("protected"), F.lit("private")), (number % 3 + 1).cast("int"))
        return rows.select(F.concat(F.lit("m:"), fqn, F.lit("#"), name).alias("chunk_id"), F.lit("method").alias("type"), fqn.alias("fqn"), owner.alias("class_name"), name.alias("method_name"), package.alias("package"), kind.alias("visibility"), F.lit("").alias("extends"), F.lit("").alias("implements"), F.concat(F.lit("/** about */\n  "), kind, F.lit(" void "), name, F.lit("()\n")).alias("body"))

    suppliers = _table(spark, folder, "supplier").join(F.broadcast(placed), F.col("s_nationkey") == F.col("n_nationkey"))
    customers = _table(spark, folder, "customer").join(F.broadcast(placed), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        overviews(regions, F.col("r_name"), F.lit("world"), F.lit(""), F.lit("")),
        overviews(placed, F.col("n_name"), F.col("r_name"), F.col("r_name"), F.concat(F.lit("I"), (F.col("n_nationkey") % 3).cast("string"))),
        overviews(suppliers, F.translate("s_name", "#", "_"), F.col("n_name"), F.col("n_name"), F.lit("")),
        methods(customers, F.col("n_name"), F.col("r_name"), F.translate("c_name", "#", "_"), F.col("c_custkey")),
        methods(regions, F.col("r_name"), F.lit("world"), F.concat(F.lit("market"), F.col("r_regionkey")), F.lit(0)),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.withColumn("source", F.lit("api"))


def _asked_suppliers(spark, folder) -> DataFrame:
    return _table(spark, folder, "supplier").where(F.col("s_suppkey") % 50 == 0).select(F.col("s_suppkey").alias("query_id"), F.translate("s_name", "#", "_").alias("name"))


def inherited_methods(spark, folder):
    """Public and protected methods that a supplier's class inherits from its nation and region."""
    return graph.inherited_methods(class_chunks(spark, folder), _asked_suppliers(spark, folder))


def class_info(spark, folder):
    """What a simple name, a full name, a misspelt name stand for."""
    names = _frame(spark, literals.CLASS_NAMES, "query_id int, name string")
    return graph.class_info(class_chunks(spark, folder), names).select("query_id", "tier", "chunk_id", F.length("body").alias("size"))


def class_report(spark, folder):
    names = _frame(spark, literals.CLASS_NAMES, "query_id int, name string")
    return graph.class_report(class_chunks(spark, folder), names)


def class_hierarchy(spark, folder):
    regions = _table(spark, folder, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("name"))
    nations = _table(spark, folder, "nation").select((F.col("n_nationkey") + 100).alias("query_id"), F.col("n_name").alias("name"))
    found = graph.hierarchy(class_chunks(spark, folder), regions.unionByName(nations))
    return found.select("query_id", "fqn", "extends", "implements", "parent_extends", "n_subclasses", F.concat_ws(",", "subclasses").alias("subclasses"))


def method_boost(spark, folder):
    """Up to three methods of each method name that a query has."""
    rows = class_chunks(spark, folder).where(F.col("type") == "method").withColumn("method_name", F.concat(F.lit("call"), F.initcap(F.translate("class_name", "_", ""))))
    found = boosts.exact_identifiers(_frame(spark, literals.METHOD_QUERIES, "query_id int, query string"), rows, ("api",))
    return found.select("query_id", "chunk_id", F.col("ord").cast("int").alias("ord"))


def api_snapshot(spark, folder):
    found = diff.snapshot(class_chunks(spark, folder))
    return found.select("fqn", "class_name", "package", "extends", "implements", F.concat_ws(",", "methods").alias("methods"), F.concat_ws(",", "fields").alias("fields"))


def diff_summary(spark, folder):
    """The summary of the differences of two halves of the orders, by clerk's priority lists."""
    orders = _table(spark, folder, "orders")
    cut = F.lit(literals.CUT).cast("timestamp")
    half = lambda d: diff.sets(d, "o_custkey", "o_orderpriority", "priorities")
    found = diff.differences(half(orders.where(F.col("o_orderdate") < cut)), half(orders.where(F.col("o_orderdate") >= cut)), "o_custkey", (), ("priorities",))
    return diff.summary(found, "o_custkey")


def metadata_scan(spark, folder):
    """Lists of values, inequality and ranges, with an offset and a limit, in order of id."""
    rows = _table(spark, folder, "part").withColumn("chunk_id", F.col("p_partkey"))
    found = store.get(rows, isin={"p_size": [1, 5, 9, 14, 23]}, differs={"p_brand": "Brand#13"}, at_least={"p_retailprice": 950.0}, below={"p_retailprice": 1800.0}, offset=5, limit=40)
    return found.select("p_partkey", "p_brand", "p_size")


def files_by_folder(spark, folder):
    return store.files_by_folder(_table(spark, folder, "pages").select(F.col("url").alias("file")))


def text_functions(spark, folder):
    """Small text functions over all documents."""
    docs = _table(spark, folder, "documents")
    label = F.concat_ws(" ", "source", "lang", F.concat(F.lit("a/b "), F.col("doc_id")))
    return docs.select("doc_id", X.shortened(X.second_line(F.col("text")), 200).alias("second"), X.clean_label(label).alias("label"), X.clean_name(label).alias("name"), X.hash_prefix(F.md5("text")).alias("digest"), X.grouped(F.col("n_chars")).alias("shown"))


def find_usages(spark, folder):
    return code.usages(_table(spark, folder, "documents").select(F.col("doc_id").alias("file"), "text"), "on")


def find_usages_topk(spark, folder):
    pages = _table(spark, folder, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text"))
    return code.first_usages(_table(spark, folder, "documents").select(F.col("doc_id").alias("file"), "text"), "stupid", 10, code.usages(pages, "stupid"))


def stored_grams(spark: SparkSession, folder: str) -> grams.GramIndex:
    """The gram index of a folder's documents, written to the shared folder once a session."""
    key, path = _stored_at(spark, folder, "grams", (), ("documents",))
    if key not in _WRITTEN:
        grams.GramIndex.write(spread(_table(spark, folder, "documents")).select(F.col("doc_id").alias("file"), "text"), path)
        _WRITTEN[key] = path
    return grams.GramIndex.read(spark, _WRITTEN[key])


def indexed_usages(spark, folder):
    """Usages of a name in all documents, from those that the gram index leaves."""
    return stored_grams(spark, folder).usages(literals.USED)


def snapshot_diff_by_group(spark, folder):
    """The differences of two versions of the customers' order priorities, of which most segments did not change, by digests of segments."""
    orders = _table(spark, folder, "orders").join(_table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = lambda d: d.groupBy("o_custkey", "c_mktsegment").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))
    later = orders.where((F.col("c_mktsegment") != literals.SEGMENT) | (F.col("o_orderdate") < F.lit(literals.CUT).cast("timestamp")))
    old, new = diff.changed_rows(rows(later), rows(orders), "c_mktsegment")
    found = diff.differences(old, new, "o_custkey", (), ("priorities",))
    return found.select("o_custkey", "kind", F.concat_ws("; ", "changes").alias("changes"))


def example_usages(spark, folder):
    """Usages of a name in documents, then in the best conversations for it, labelled by where they are."""
    files = _table(spark, folder, "documents").select(F.format_string("%012d", "doc_id").alias("file"), "text")
    asked = _frame(spark, [(1, literals.USED)], "query_id int, query string")
    hits = keyword.keyword_search(stored_index(spark, folder).only("mod"), asked, 10)
    repo = F.when(F.col("chunk_id").endswith("_0"), F.lit(None)).otherwise(F.regexp_extract("chunk_id", "^c([0-9]+)_", 1))
    chunks = all_chunks(spark, folder).where(F.col("source") == "mod").select("chunk_id", F.col("chunk_id").alias("file"), repo.alias("repo"), "body")
    return code.labelled_usages(files, literals.USED, code.example_usages(hits, chunks), 40)


def _filled(template: str, **columns) -> Column:
    """A text whose names between < and > are columns."""
    return F.concat(*[columns[part] if i % 2 else F.lit(part) for i, part in enumerate(re.split("<([a-z]+)>", template)) if part])


def class_files(spark, folder) -> DataFrame:
    """A source file for each customer, a class whose methods are the orders, named by their priorities: (file, text)."""
    word = F.lower(F.regexp_extract("o_orderpriority", "-([A-Z]+)", 1))
    body = _filled(literals.METHOD_TEXT, key=F.col("o_orderkey").cast("string"), word=word, priority=F.col("o_orderpriority"))
    orders = _table(spark, folder, "orders").select("o_custkey", F.struct("o_orderkey", body.alias("body")).alias("m"))
    methods = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["body"]), "").alias("methods"))
    name = F.translate("c_name", "#", "_")
    rows = _table(spark, folder, "customer").join(methods, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.concat(F.lit("shop/"), name, F.lit(".java")).alias("file"), _filled(literals.CLASS_TEXT, name=name, methods=F.coalesce("methods", F.lit(""))).alias("text"))


def class_members(spark, folder):
    """Methods and constructors of all customers' files, with their places."""
    return code.members(class_files(spark, folder)).select("file", "name", "constructor", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def method_span(spark, folder):
    """Whole sources of a method, of constructors and of what is missing, looked up by class, for every tenth customer."""
    none, name = F.lit(None).cast("string"), F.translate("c_name", "#", "_")
    rows, place = _table(spark, folder, "customer"), F.col("c_custkey") % 7
    file = F.when(place == 1, F.lit("")).when(place == 2, F.concat(F.lit("gone/"), name)).otherwise(F.concat(F.lit("shop/"), name, F.lit(".java")))
    chunks = rows.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("chunk_id"), F.lit("api").alias("source"), F.lit("class_overview").alias("type"), F.concat(F.lit("shop."), name).alias("fqn"), name.alias("class_name"), none.alias("method_name"), file.alias("file"))
    asked = rows.where(F.col("c_custkey") % 10 == 0)
    fqn = F.when(F.col("c_custkey") % 20 == 0, F.concat(F.lit("shop."), name)).when(F.col("c_custkey") % 50 == 0, F.lit("Nobody")).otherwise(name)
    methods = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("m")) for i, m in enumerate(("urgent", "<init>", "low", "absent"))]))
    wanted = asked.select(F.col("c_custkey"), fqn.alias("class_name"), methods.alias("w")).select((F.col("c_custkey") * 10 + F.col("w.no")).alias("query_id"), "class_name", F.col("w.m").alias("method_name"))
    return code.method_report(chunks, class_files(spark, folder), wanted)


def field_section(spark, folder):
    """Fields of overviews that are made of all parts."""
    head = F.concat(F.lit("class P"), F.col("p_partkey"), F.when(F.col("p_size") % 5 == 0, F.lit("\n// Extends: Q")).otherwise(F.lit("")))
    fields = F.concat(F.lit("\n// Fields:\n  int size"), F.col("p_size"), F.lit(";\n\n "), F.translate("p_type", " ", "_"), F.lit(" kind ;;\n"), F.translate("p_name", " ", ";"), F.lit("\n"))
    end = F.when(F.col("p_size") % 3 == 0, F.lit("// Methods:\nrun();")).when(F.col("p_size") % 3 == 1, F.lit("// Implements: A, B\n// Inherited methods:\nint y;")).otherwise(F.lit(""))
    rows = _table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat(head, F.when(F.col("p_size") % 7 == 0, F.lit("\n")).otherwise(fields), end).alias("body"))
    return rows.select("id", F.concat_ws("|", X.fields_of(F.col("body"))).alias("fields"))


def snapshot_build(spark, folder):
    rows = _table(spark, folder, "lineitem").groupBy("l_orderkey").agg(*[F.concat_ws(",", F.sort_array(F.collect_set(c))).alias(n) for c, n in (("l_returnflag", "flags"), ("l_linestatus", "states"))])
    return rows.select("l_orderkey", "flags", "states")


def snapshot_diff(spark, folder):
    orders = _table(spark, folder, "orders")
    cut = F.lit(literals.CUT).cast("timestamp")
    half = lambda d: diff.sets(d, "o_custkey", "o_orderpriority", "priorities")
    found = diff.differences(half(orders.where(F.col("o_orderdate") < cut)), half(orders.where(F.col("o_orderdate") >= cut)), "o_custkey", (), ("priorities",))
    return found.select("o_custkey", "kind", F.concat_ws("; ", "changes").alias("changes"))


def chunk_windows(spark, folder):
    return store.chunk_windows(_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


def index_status(spark, folder):
    meta = _frame(spark, literals.META, "collection string, indexed_at string, embed_model string, repo_count long")
    return store.status(all_chunks(spark, folder), meta)


def tier_asset_sizes(spark, folder):
    """Files and sizes of each tier, of assets named after all parts."""
    name = F.concat(F.when(F.col("p_size") % 4 == 0, F.lit("notes-")).otherwise(F.lit("data-")), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, F.lit("-vectors-")).otherwise(F.lit("-")), F.col("p_partkey"), F.lit(".zip"))
    assets = _table(spark, folder, "part").select(name.alias("name"), (F.col("p_partkey") * 1000 + F.col("p_size")).cast("long").alias("size"))
    parts = [store.tier_assets(assets, "data-", t).agg(F.lit(t).alias("tier"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")) for t in ("lite", "full")]
    return parts[0].unionByName(parts[1])


def _jobs(spark, folder) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    return _table(spark, folder, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("started_at"))


def job_status(spark, folder):
    return store.jobs_shown(_jobs(spark, folder)).select("job_id", "status")


def log_tail(spark, folder):
    logs = _table(spark, folder, "events").select(F.col("event_id").alias("log_id"), F.col("ts").alias("time"), F.col("event_type").alias("level"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return store.log_tail(logs).select("log_id", "level", "k")


def class_hits_by_source(spark, folder):
    """Chunks and distinct classes of each source."""
    return all_chunks(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("fqn").alias("classes"))


def last_writer(spark, folder):
    """The latest order of each customer, as a snapshot keeps the last of several overviews."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    rows = _table(spark, folder, "orders").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return rows.select("o_custkey", "o_orderkey", "o_orderpriority")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        index_build, bm25_fields, porter_terms, search_mods_pipeline, search_api_by_type, dashboard_guides, dashboard_package, hybrid_all_pipeline, hybrid_api_pipeline, hybrid_guides_pipeline, hybrid_dashboard, chunk_bodies, rendered_results,
        json_results, index_fallback, package_totals, inherited_methods, class_info, class_report, class_hierarchy, method_boost, api_snapshot, diff_summary, metadata_scan, files_by_folder, text_functions,
        bm25_topk, bm25_batch_queries, phrase_topk, query_parse_terms, mini_stem_df, postings_stats, vector_topk, vector_index_topk, vector_index_recall, vector_topk_filtered, recall_at_k, prefix_filter, rrf_fusion, identifier_gate, dedup_per_key, source_slots,
        exact_boost, token_overlap_boost, bridge_boost, search_all_pipeline, search_single_pipeline, search_guides_pipeline, dashboard_search, package_rollup, subclass_lookup, implementors, recursive_ancestors,
        find_usages, find_usages_topk, indexed_usages, snapshot_diff_by_group, example_usages, class_members, method_span, field_section, snapshot_build, snapshot_diff, chunk_windows, index_status, tier_asset_sizes, job_status, log_tail, class_hits_by_source, last_writer,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name, where SQL can express the result."""
    return catalog_sql.statements()
