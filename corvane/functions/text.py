"""Text expressions: all of them built-in functions, so that plans stay inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SECTIONS, STOPWORDS

TOKEN = r"[\p{L}\p{N}]+"
# How identifiers split in queries and in class names.
QUERY_HUMPS = r"[A-Z][a-z]+|[A-Z]+(?=[A-Z]|$)|[a-z]+"
CLASS_HUMPS = r"[A-Z][a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\b)"
CLASS_TOKEN = r"\b[A-Z][a-zA-Z0-9]{2,}\b"
METHOD_TOKEN = r"\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b"
HUMPED_NAME = r"\b([A-Z][a-zA-Z0-9]*(?:[A-Z][a-z][a-zA-Z0-9]*)+)\b"
TICKED_NAME = r"`([A-Za-z_][\w.]*)`"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_words(text: Column) -> Column:
    """White-space words with only letters, digits, '.' and '_' left, of two characters or more and no stopwords."""
    cleaned = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}._]", ""))
    return F.filter(cleaned, lambda w: (F.length(w) >= 2) & ~F.array_contains(literals(STOPWORDS), F.lower(w)))


def query_parts(word: Column) -> Column:
    """A word's phrases: itself and, if it has several humps, those of two characters or more that are no stopwords."""
    humps = F.regexp_extract_all(word, F.lit(QUERY_HUMPS), F.lit(0))
    good = F.filter(humps, lambda h: (F.length(h) >= 2) & ~F.array_contains(literals(STOPWORDS), F.lower(h)))
    return F.concat(F.array(word), F.when(F.size(humps) > 1, good).otherwise(F.array().cast("array<string>")))


def stem(word: Column) -> Column:
    """The short stemmer: one suffix, the first that fits, of words long enough for it."""
    cut = lambda n: F.substr(word, F.lit(1), F.length(word) - n)
    ends = lambda s, n: word.endswith(s) & (F.length(word) > n)
    return F.when(ends("ing", 5), cut(3)).when(ends("tion", 6), cut(4)).when(ends("ed", 4), cut(2)).when(ends("ly", 4), cut(2)).when(ends("s", 4) & ~word.endswith("ss"), cut(1)).otherwise(word)


def class_stems(name: Column, noise) -> Column:
    """Distinct stems of a class name's humps of three letters or more, without noise."""
    humps = F.filter(F.regexp_extract_all(name, F.lit(CLASS_HUMPS), F.lit(0)), lambda h: F.length(h) >= 3)
    return F.array_except(F.array_distinct(F.transform(humps, lambda h: stem(F.lower(h)))), literals(noise))


def query_stems(text: Column, noise) -> Column:
    """Distinct stems of a query's words of three small letters or more, without noise."""
    return F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), stem)), literals(noise))


def names_identifier(text: Column) -> Column:
    """Whether a query looks as if it named something: a capital, a dot or an underscore in it."""
    return F.coalesce(text.rlike("[A-Z._]"), F.lit(False))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def csv(text: Column) -> Column:
    """Trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.split(F.trim(text), r"\s*,\s*"), lambda x: x != "")


def second_line(text: Column) -> Column:
    """The second line, or the whole text if there is but one."""
    return F.coalesce(F.try_element_at(F.split(text, "\n"), F.lit(2)), text)


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def whole_word(word: str) -> str:
    """A pattern for a word between characters that are no letters, digits or '_', alike in all engines."""
    quoted = re.sub(r"([^\w])", r"\\\1", word)
    return rf"(^|[^\p{{L}}\p{{N}}_]){quoted}([^\p{{L}}\p{{N}}_]|$)"


def fields_of(overview: Column) -> Column:
    """Declarations in the field section of a class overview, without ';' and blank lines."""
    others = "|".join(s.replace("/", r"\/") for s in SECTIONS[1:])
    section = F.regexp_extract(overview, rf"(?s)\/\/ Fields:(.*?)(?:{others}|$)", 1)
    lines = F.transform(F.split(section, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r";+$", "")))
    return F.filter(lines, lambda x: x != "")


def clean_label(label: Column) -> Column:
    return F.substring(F.translate(label, " /", "__"), 1, 30)


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "")


def hash_prefix(digest: Column, digits: int = 16) -> Column:
    """The first digits of a digest and dots, as they are shown; nothing where there is none."""
    return F.when(F.coalesce(digest, F.lit("")) != "", F.concat(F.substring(digest, 1, digits), F.lit("..."))).otherwise(F.lit(""))


def grouped(number: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(number, 0)
