"""Spacing status, severity and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.config import CONFIG, Config
from tramline.functions.ids import as_column

BUNCHING = ("SEVERE_BUNCHING", "BUNCHING")
GAPPING = ("GAPPING", "SEVERE_GAPPING")
ALERTABLE = BUNCHING + GAPPING
SEVERITY = {"SEVERE_BUNCHING": 2, "SEVERE_GAPPING": 2, "BUNCHING": 1, "GAPPING": 1}  # 0 for all others


def from_ratio(ratio: Column | str, c: Config = CONFIG) -> Column:
    """Status of a ratio of least to expected gap; limits belong to the worse side. Null for null."""
    r = as_column(ratio)
    return (
        F.when(r <= c.severe_bunching, "SEVERE_BUNCHING")
        .when(r <= c.bunching, "BUNCHING")
        .when(r >= c.severe_gapping, "SEVERE_GAPPING")
        .when(r >= c.gapping, "GAPPING")
        .when(r.isNotNull(), "ON_SCHEDULE")
    )


def alertable(status: Column | str) -> Column:
    """False for null and unknown statuses."""
    return F.coalesce(as_column(status).isin(*ALERTABLE), F.lit(False))


def severity(status: Column | str) -> Column:
    s, at = as_column(status), lambda rank: [k for k, v in SEVERITY.items() if v == rank]
    return F.when(s.isin(*at(2)), 2).when(s.isin(*at(1)), 1).otherwise(0)


def is_worse(status: Column, ratio: Column, than: Column, than_ratio: Column) -> Column:
    """By severity, then by distance of the ratio from 1; a null ratio is never worse at equal severity."""
    a, b = severity(status), severity(than)
    return F.when(a != b, a > b).otherwise(F.coalesce(F.abs(ratio - 1) > F.abs(than_ratio - 1), F.lit(False)))


def disorder(status: Column | str, ratio: Column | str) -> Column:
    """Distance from the schedule; -1 unless alertable with a ratio."""
    r = as_column(ratio)
    return F.when(alertable(status) & r.isNotNull(), F.abs(r - 1)).otherwise(F.lit(-1.0))


def route_name(short: Column | str, long: Column | str) -> Column:
    """short and long name with a blank between; short alone if the long one is blank."""
    s, n = as_column(short), as_column(long)
    return F.when(n.isNull() | (F.trim(n) == ""), s).otherwise(F.concat(s, F.lit(" "), n))


def record_name(long: Column | str, short: Column | str, group: Column | str) -> Column:
    """The first that isn't blank."""
    some = lambda c: F.when(F.trim(as_column(c)) != "", as_column(c))
    return F.coalesce(some(long), some(short), as_column(group))


def episode_id(group: Column | str, at: Column | str) -> Column:
    return F.concat(as_column(group), F.lit("@"), F.unix_millis(as_column(at).cast("timestamp")).cast("string"))
