"""Terms of keyword arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_terms(words: Column) -> Column:
    """The words without outer blanks, in lower case, without null and empty ones; null gives an empty array."""
    clean = F.transform(words, lambda w: F.lower(F.trim(w)))
    return F.coalesce(F.filter(clean, lambda w: w.isNotNull() & (w != "")), F.array().cast("array<string>"))


def term_set(words: Column) -> Column:
    """The distinct clean terms, sorted."""
    return F.array_sort(F.array_distinct(clean_terms(words)))
