"""Tokens and n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; white space and punctuation part them."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """n neighbouring tokens joined by a blank; none for a shorter array. words is evaluated once."""
    if n == 1:
        return words

    def of(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def md5_16(c: Column) -> Column:
    return F.substring(F.md5(c), 9, 16)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def module_of(feature: Column, parts: int = 2) -> Column:
    """The service or module that a feature's name begins with."""
    return F.substring_index(feature, "_", parts)
