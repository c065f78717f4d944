"""The corpus pipeline: five stages over documents, each one operator of the corpus subpackage.

Language ID drops what no language's model explains; the n-gram Jaccard join keeps one document of each group of copies;
personal data is replaced in the texts; sources are mixed to their target weights by repeating or leaving out documents;
the texts are encoded. Each stage takes the documents that the one before kept; all but the last return their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import jaccard, language, mixing, pieces, pii
from corvane.llm.common import rest
from corvane.llm.queries import model_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit language models to the labelled documents and drop documents that they reject.

    Null, empty and letterless texts go; equal texts fare alike; an empty table stays empty; all columns stay, whatever their names.
    """
    rest(spark)
    return language.accepted(docs, language.fit(docs, F.lit(True)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, of the least id; ties and repeated rows leave one.

    Null and empty texts are in no group and stay; an empty table stays empty; all columns stay, whatever their names.
    """
    rest(spark)
    return jaccard.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and what discloses it; n_chars follows the text.

    Null and empty texts stay as they are; equal texts become equal; an empty table stays empty; all columns stay, whatever their names.
    """
    rest(spark)
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets.

    Null and empty texts are left out; a null source is one of its own; equal rows share their copies; an empty table stays
    empty; all columns stay, whatever their names.
    """
    rest(spark)
    return mixing.mixed_rows(docs)


#: Units that a worker's encoder remembers: fewer than alone, as the executors are grown by the stages before.
MEMO_UNITS = 40_000


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each document: its ids, their number and digests.

    A null or empty text has the end id alone; repeated rows are encoded row by row; an empty table gives an empty result;
    columns other than doc_id, source and text are left out.
    """
    rest(spark)
    return pieces.encode_pieces(docs, model_path(), ("doc_id", "source"), texts=True, decoded=False, units=MEMO_UNITS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", identify),
    ("n-gram jaccard join", deduplicate),
    ("personal data", sanitise),
    ("mixing sources", mix),
    ("piece encoding", encode),
]

#: Language models, the mix's draws and piece encoding are beyond SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; each stage's result is written to the shared folder and read again.

    A copy is deleted once the next one is written; the last stage reads the one that stays.
    """
    from corvane.llm.common import discard, filed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        made = filed(made)
        discard(docs)
        docs = made
    return docs
