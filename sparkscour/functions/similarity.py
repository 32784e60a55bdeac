"""Edit-distance and word-overlap similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col, collapse_space



def words(c: Column | str) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.array_remove(F.split(collapse_space(c), " "), ""))


def overlap(a_words: Column, b_words: Column) -> Column:
    """Shared words over all words of two distinct word arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(a_words, b_words))
    total = F.size(a_words) + F.size(b_words) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def levenshtein_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(as_col(a), as_col(b))


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a), as_col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1) - F.levenshtein(a, b) / longest)


def jaccard_similarity(a: Column | str, b: Column | str) -> Column:
    return overlap(words(a), words(b))


def blend(lev: Column, jac: Column) -> Column:
    return lev * F.lit(0.7) + jac * F.lit(0.3)


def combined_similarity(a: Column | str, b: Column | str) -> Column:
    return blend(levenshtein_similarity(a, b), jaccard_similarity(a, b))


def similarity(a: Column | str, b: Column | str, strategy: str = "levenshtein") -> Column:
    """Similarity by strategy; an unknown strategy means edit distance."""
    if strategy == "jaccard":
        return jaccard_similarity(a, b)
    if strategy == "combined":
        return combined_similarity(a, b)
    return levenshtein_similarity(a, b)
