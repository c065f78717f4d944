"""Fixed values of the engine's rankings and caps, and the canonical schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Limits:
    """Caps and constants that decide results."""

    rrf_k: int = 60
    keyword_weight: float = 0.3
    keyword_fetch: int = 3
    least_fetch: int = 30
    per_class: int = 2
    slots: tuple[tuple[str, int], ...] = (("api", 2), ("guide", 2), ("mod", 1))
    method_tokens: int = 3
    method_hits: int = 3
    bridge_hits: int = 6
    bridge_names: int = 10
    overlap_names: int = 2
    ancestors: int = 6
    packages_shown: int = 20
    relations_shown: int = 30
    changes_shown: int = 5
    classes_shown: int = 20
    signature_chars: int = 200
    text_chars: int = 500
    chunk_chars: int = 1500
    chunk_overlap: int = 200
    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6


LIMITS = Limits()

# Words that keyword queries leave out.
STOPWORDS = [
    "a", "all", "an", "and", "are", "at", "be", "been", "but", "by", "can", "do", "does", "for", "from", "had", "has", "have", "how", "in", "is",
    "it", "not", "of", "on", "or", "that", "the", "their", "there", "this", "to", "was", "what", "which", "will", "with", "would",
]
# Words that are no class name in a query.
BOOST_SKIP = [
    "add", "all", "also", "any", "are", "been", "can", "did", "does", "each", "end", "for", "from", "get", "has", "have", "how", "into", "its",
    "just", "let", "may", "new", "not", "now", "out", "own", "per", "put", "run", "say", "see", "set", "that", "the", "this", "try", "use", "used",
    "via", "was", "way", "what", "when", "why", "will", "with", "yet",
]
# Stems that say nothing about a class.
CLASS_NOISE = [
    "abstract", "add", "all", "and", "any", "are", "base", "been", "can", "component", "default", "does", "ecs", "event", "for", "from", "get", "has",
    "have", "how", "impl", "into", "new", "not", "over", "post", "pre", "set", "system", "that", "the", "this", "type", "use", "was", "what", "when",
    "where", "which", "who", "with",
]
# Section marks of a class overview.
SECTIONS = ("// Fields:", "// Methods:", "// Extends:", "// Implements:", "// Inherited methods:")

_S = T.StringType()
CHUNKS = T.StructType(
    [T.StructField(c, _S) for c in "chunk_id source type fqn class_name method_name package visibility extends extends_fqn implements file title heading url repo body".split()]
)
SNAPSHOT = T.StructType([T.StructField(c, _S) for c in "fqn class_name package extends implements".split()] + [T.StructField(c, T.ArrayType(_S)) for c in ("methods", "fields")])
BACKUPS = T.StructType([T.StructField("file", _S), T.StructField("count", T.LongType()), T.StructField("label", _S), T.StructField("created_at", _S), T.StructField("size_mb", T.DoubleType())])
