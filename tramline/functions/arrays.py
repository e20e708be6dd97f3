"""Medians, differences and pairs of arrays, where an aggregate can't be used (streams)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(xs: Column) -> Column:
    """The middle value, or the mean of the middle two; null for no values."""
    s, n = F.sort_array(xs), F.size(xs)
    at = lambda k: F.get(s, k.cast("int"))
    half = F.floor(n / 2)
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)


def upper_median(xs: Column) -> Column:
    """The value at place size / 2 of the sorted array; null for no values."""
    return F.get(F.sort_array(xs), F.floor(F.size(xs) / 2).cast("int"))


def differences(xs: Column) -> Column:
    """Each value less the one before; empty for fewer than two."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.zip_with(F.slice(xs, 1, n), F.slice(xs, 2, n), lambda a, b: b - a)


def least_pair(gaps: Column, names: Column) -> Column:
    """The two names beside the first least gap; null without gaps."""
    return F.when(F.size(gaps) > 0, F.slice(names, F.array_position(gaps, F.array_min(gaps)).cast("int"), 2))
