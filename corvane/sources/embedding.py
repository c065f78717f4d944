"""Embedding providers: any function from texts to vectors, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

# What the embedding model expects before documents and queries.
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "

Provider = Callable[[list[str]], list[list[float]]]


def embed(rows: DataFrame, key: str, text: str, provider: Provider, prefix: str = DOCUMENT_PREFIX) -> DataFrame:
    """(key, embedding) of each row; the provider is called once a batch, and a query once for all collections."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": provider([prefix + (t or "") for t in pdf[text]])})

    source = rows.select(key, text)
    return source.mapInPandas(run, f"`{key}` {source.schema[key].dataType.simpleString()}, embedding array<float>")


def other_models(meta: DataFrame, model: str) -> DataFrame:
    """Collections that were embedded with another model than the one in use."""
    return meta.where("embed_model IS NOT NULL").where(meta["embed_model"] != model)
