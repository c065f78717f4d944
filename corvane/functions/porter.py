"""The Porter stemmer and accent folding, for the distinct words of a vocabulary."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix rules of steps 2 to 4 of the published algorithm.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """'c' for consonants and 'v' for vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(part: str) -> int:
    return _shape(part).count("vc")


def _hissing(part: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return _shape(part).endswith("cvc") and part[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted((s for s in rules if word.endswith(s)), key=len, reverse=True)[:1]:
        part = word[: -len(suffix)]
        if _measure(part) > least:
            return part + rules[suffix]
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other signs than a-z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _hissing(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2, 0), STEP_3, 0)
    for suffix in sorted((s for s in STEP_4 if word.endswith(s)), key=len, reverse=True)[:1]:
        part = word[: -len(suffix)]
        if _measure(part) > 1 and (suffix != "ion" or part.endswith(("s", "t"))):
            word = part
    if word.endswith("e"):
        part = word[:-1]
        if _measure(part) > 1 or (_measure(part) == 1 and not _hissing(part)):
            word = part
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def folded(word: str) -> str:
    """Lower case without marks on its letters."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def analysed(word: Column) -> Column:
    """Fold and stem a column of words; meant for distinct ones."""
    return F.pandas_udf(lambda s: pd.Series([porter(folded(x)) if x is not None else None for x in s]), StringType())(word)
