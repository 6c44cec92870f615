"""Text columns: Unicode words, word n-grams, normal form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \w is ASCII only; the engine's words are Unicode letters, digits and the underscore.
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-case Unicode words, in order (PRJ-17)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: Catalyst would else repeat an inlined expression for each element of a lambda."""
    return F.transform(F.array(value), body)[0]


def word_ngrams(w: Column, n: int = 8) -> Column:
    """Distinct n-grams of a word array; empty if it has fewer than n words (PRJ-18)."""

    def grams(v: Column) -> Column:
        # by element, as slice() copies the whole array each time
        some = F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: F.concat_ws(" ", *(F.get(v, i + k) for k in range(n))))
        return F.when(F.size(v) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))

    return let(w, grams)


def normal_form(text: Column) -> Column:
    """Words joined by one space (PRJ-19)."""
    return F.array_join(words(text), " ")


def gram_hashes(w: Column, n: int = 8) -> Column:
    """Distinct n-grams of a word array as 64-bit hashes; empty if it has fewer than n words."""

    def grams(v: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(n))))
        return F.when(F.size(v) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), grams)
