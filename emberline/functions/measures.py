"""Similarities, entropies and other scalar measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the union of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.nullif(union, F.lit(0)))


def jaccard_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - jaccard(a, b)


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 1 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.nullif(small, F.lit(0)))


def xlogx(x: Column) -> Column:
    return x * F.log2(x)


def entropy(*counts: Column) -> Column:
    """Entropy (bits) of a distribution given by counts, each smoothed by 1e-9."""
    smooth = [c.cast("double") + F.lit(1e-9) for c in counts]
    total = smooth[0]
    for c in smooth[1:]:
        total = total + c
    value = xlogx(smooth[0] / total)
    for c in smooth[1:]:
        value = value + xlogx(c / total)
    return -value


def information_gain(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Mutual information of the 2 x 2 table: pair in the window before and now (a, b), other posts (c, d)."""
    return entropy(a + c, b + d) + entropy(a + b, c + d) - entropy(a, b, c, d)


def tanimoto_distance(a: Column, b: Column) -> Column:
    """1 - Tanimoto similarity of two binary vectors given as sets; null if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.lit(1.0) - F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared)


def weighted_tanimoto_distance(a: Column, b: Column) -> Column:
    """The same of two vectors of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    shared = dot(a, b)
    return F.lit(1.0) - F.try_divide(shared, dot(a, a) + dot(b, b) - shared)


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(a) - F.unix_timestamp(b)


def beta_moments(mean: Column, variance: Column) -> tuple[Column, Column]:
    """Parameters of a beta distribution by its moments; null without variance."""
    common = F.try_divide(mean * (F.lit(1.0) - mean), variance) - F.lit(1.0)
    return mean * common, (F.lit(1.0) - mean) * common
