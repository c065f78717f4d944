"""The thin queries of this subpackage: they bind the operators to the tables and derive digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .common import held_out, table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public vocabulary file lies; never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(spread(table(spark, sf_dir, "documents")), model_path())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents")).drop("__set")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_pieces

    return encode_pieces(spread(table(spark, sf_dir, "documents")), model_path())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import ogg_media

    return ogg_media(spread(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spread(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract_pages

    return extract_pages(spread(table(spark, sf_dir, "pages")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out("doc_id", 3))
    out = predict(spread(docs), model)
    return out.select("doc_id", held_out("doc_id", 3).alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import host_rules

    return host_rules(spread(table(spark, sf_dir, "documents")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5))
    return lm_scores(docs, ~docs["held_out"], ("doc_id", "held_out"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spread(table(spark, sf_dir, "documents")), model_path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spread(table(spark, sf_dir, "embeddings")).withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import importance_resample

    return importance_resample(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name, where SQL can express the result."""
    from .oracles import statements

    return statements()
