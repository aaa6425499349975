"""Text functions: tokens and sentences by rule, cleaning, verb forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
# Fixed values.
COPULAS = ["is", "am", "are", "was", "were", "be", "been", "being"]
SUFFIX_PLURAL = r"(?i)(?:ss|us|is)$"


def tokenize(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    return F.split(text, " ")


def split_sentences(text: Column) -> Column:
    """Cut after '.', '!' or '?' and white space, and after each ';', which stays with what is before it."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|(?<=;)"), lambda s: F.trim(s)), lambda s: s != "")


def clean(word: Column) -> Column:
    """What stands before the first parenthesis."""
    return F.substring_index(word, "(", 1)


def is_copula(word: Column) -> Column:
    return word.isin(COPULAS)


def stem(word: str) -> str:
    """The base form of a regular verb form."""
    low = word.lower()
    if low.endswith("ing") and len(low) > 4:
        base = low[:-3]
    elif low.endswith("ied") or low.endswith("ies"):
        return low[:-3] + "y"
    elif low.endswith("ed") and len(low) > 3:
        base = low[:-2]
    elif low.endswith("s") and not low.endswith("ss"):
        return low[:-1]
    else:
        return low
    vowels = "aeiou"
    if len(base) > 2 and base[-1] == base[-2] and base[-1] not in "lsfz" + vowels:
        return base[:-1]
    groups = sum(1 for a, b in zip(" " + base, base) if b in vowels + "y" and a not in vowels + "y")
    short = len(base) > 1 and groups == 1 and base[-1] not in vowels + "wxy" and base[-2] in vowels and (len(base) < 3 or base[-3] not in vowels)
    return base + "e" if short or base[-1:] in "vcu" and base[-1:] else base
