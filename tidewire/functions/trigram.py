"""Trigram similarity of names: two blanks before and one behind every word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import fold


def trigrams(name: Column) -> Column:
    """The distinct trigrams of the folded words of a name."""
    words = F.filter(F.split(fold(name), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def overlap(a: Column, b: Column) -> Column:
    """Shared by all trigrams of two trigram sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def similarity(a: Column, b: Column) -> Column:
    return F.coalesce(overlap(trigrams(a), trigrams(b)), F.lit(0.0)).cast("float")
