"""Current state per key: outcomes of arriving pings, newest rows, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions.folds import before


def admitted(ts: Column, now: Column) -> Column:
    """Not older than the largest age and not further ahead than the allowed skew, both inclusive."""
    return (ts >= now - F.expr(f"interval {CONFIG.ping_max_age}")) & (ts <= now + F.expr(f"interval {CONFIG.clock_skew}"))


def outcomes(pings: DataFrame, key: str, ts: str, order: list[str], now: Column | None = None) -> DataFrame:
    """pings with outcome: REJECTED if not admitted at `now`, NEW for the first of its key in order of arrival,
    UPDATED if newer than all before, else STALE. Rejected pings leave no trace. Exact between evictions."""
    ok = admitted(F.col(ts), now) if now is not None else F.lit(True)
    told = before(pings, [key], order, max_of={"_seen": F.when(ok, F.col(ts))})
    seen = F.col("_seen")
    return told.withColumn("outcome", F.when(~ok, "REJECTED").when(seen.isNull(), "NEW").when(F.col(ts) > seen, "UPDATED").otherwise("STALE")).drop("_seen")


def newest(rows: DataFrame, key: str, *order: str, keep: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest by `order`. Copies of a key meet as partial aggregates."""
    cols = keep or [c for c in rows.columns if c != key]
    got = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return got.select(key, *[F.col("_row")[c].alias(c) for c in cols])


def live(rows: DataFrame, ts: str, now: Column, ttl: str) -> DataFrame:
    """Rows not older than ttl at `now`; a row just as old stays."""
    return rows.filter(F.col(ts) >= now - F.expr(f"interval {ttl}"))
