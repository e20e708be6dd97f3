"""Exact grouped medians and quantiles that no single task has to hold a group for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import keep, small_side

#: Bins per unit of log(1 + value); a group has at most about 64 * log(range) bins on either side of 0.
BINS = 64
#: Most groups whose middle bins are broadcast; with more the values are joined to them by a shuffle.
MAX_GROUPS = 300_000


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): equal values meet as partial aggregates, and a hot group is spread by value."""
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"))


def bin_of(value: str | Column) -> Column:
    """The bin of a value; bins are in the order of the values, those below 0 mirror those above."""
    v = F.col(value) if isinstance(value, str) else value
    b = F.floor(F.log1p(F.abs(v)) * BINS)
    return F.when(v < 0, -1 - b).otherwise(b)


def bin_edge(b: Column) -> Column:
    """The least value of a bin of values from 0 on."""
    return F.expm1(b / BINS)


def histogram(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _bin, _c) from (keys, value, n): partial aggregates, a bounded number of bins a group."""
    return counts.groupBy(*keys, bin_of(value).alias("_bin")).agg(F.sum("n").alias("_c"))


def grouped_ranks(counts: DataFrame, keys: list[str], value: str, ranks: dict[str, str], size: str, hist: DataFrame | None = None) -> DataFrame:
    """(keys, one column per rank, size) from (keys, value, n): the values at the given 0-based ranks.

    ranks: column name to an SQL expression in `_all`, the group's number of values. A histogram of each
    group (given as `hist`, or counted here) finds the bins of the ranks; only values in those bins are
    ordered. Values are finite numbers. Null keys form a group of their own; an empty table gives no rows.
    """
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    some = " or ".join(f"(_cum > ({r}) and _cum - _c <= ({r}))" for r in ranks.values())
    found = keep(
        (histogram(counts, keys, value) if hist is None else hist)
        .withColumn("_cum", F.sum("_c").over(w))
        .withColumn("_all", F.sum("_c").over(whole))
        .filter(some)
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), (F.col("_cum") - F.col("_c")).alias("_base"), "_all")
    )
    same = bin_of(value) == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = counts.join(small_side(found, MAX_GROUPS), same).groupBy(*keys, "_b", "_base", "_all", value).agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_hi", F.col("_base") + F.sum("n").over(own)).withColumn("_lo", F.col("_hi") - F.col("n"))
    at = lambda r: F.max(F.expr(f"case when _lo <= ({r}) and ({r}) < _hi then {value} end"))
    return placed.groupBy(*keys).agg(*[at(r).alias(c) for c, r in ranks.items()], F.max("_all").alias(size))


def grouped_median(counts: DataFrame, keys: list[str], value: str, median: str, size: str, hist: DataFrame | None = None) -> DataFrame:
    """(keys, median, size) from (keys, value, n): the mean of the two middle values."""
    two = grouped_ranks(counts, keys, value, {"_r0": "(_all - 1) div 2", "_r1": "_all div 2"}, size, hist)
    return two.select(*keys, ((F.col("_r0") + F.col("_r1")) / 2).alias(median), size)


def read_off(hist: DataFrame, keys: list[str], ranks: dict[str, Column], size: str) -> DataFrame:
    """(keys, one column per rank, size) off a histogram of values from 0 on, evenly spread within a bin: no value is
    further from the exact one than a bin is wide (1.6 % of 1 + value). ranks are columns in `_all`."""
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("_hi", F.sum("_c").over(w)).withColumn("_all", F.sum("_c").over(Window.partitionBy(*keys))).withColumn("_lo", F.col("_hi") - F.col("_c"))
    lo, hi = bin_edge(F.col("_bin")), bin_edge(F.col("_bin") + 1)

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), lo + (hi - lo) * (r - F.col("_lo") + 0.5) / F.col("_c")))

    return run.groupBy(*keys).agg(*[at(r).alias(c) for c, r in ranks.items()], F.max("_all").alias(size))
