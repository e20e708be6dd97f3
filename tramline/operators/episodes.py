"""Alert episodes: window records folded into stretches of trouble per group, in order of arrival.

A record whose window ends before one already taken is refused. An alertable record opens an episode or is
absorbed by the open one; any other closes it at its own window end; silence closes it, at `now`, where its last
window ended. A group's records are folded hour by hour (`folds.before`), each hour from what the one before hands
on; the stream form keeps one episode per group as its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions.folds import before
from tramline.functions.ids import micros
from tramline.functions.status import alertable, episode_id, severity
from tramline.session import keep

ORDER = ["emittedAt", "recordId"]


def accepted(records: DataFrame) -> DataFrame:
    """Records in order of arrival whose windowEnd is not before the newest so far; null groups and ends are refused."""
    r = before(records.filter("headwayGroup is not null and windowEnd is not null"), ["headwayGroup"], ORDER, max_of={"_top": F.col("windowEnd")})
    return r.filter("_top is null or windowEnd >= _top").drop("_top")


def segmented(taken: DataFrame) -> DataFrame:
    """taken with alert, opens, clears, episode, the running worst and the worst status before.

    An episode is told by the last record before it that is no alert: its recordId, -1 if there is none. The record that clears an episode
    has the same.
    """
    calm = F.when(~F.col("alert"), F.struct(*ORDER))
    # written before and after, since every fold reads its rows twice
    a = keep(taken.withColumn("alert", alertable("status")))
    a = keep(before(a, ["headwayGroup"], ORDER, lag_of={"_was": F.col("alert")}, max_of={"_calm": calm}))
    was = F.coalesce("_was", F.lit(False))
    e = a.withColumns({"opens": F.col("alert") & ~was, "clears": ~F.col("alert") & was, "_sev": severity("status"), "episode": F.coalesce(F.col("_calm.recordId"), F.lit(-1))}).drop("_was", "_calm")
    keys = ["headwayGroup", "episode", "alert"]
    firsts = e.groupBy(*keys, "_sev").agg(F.min(F.struct(*ORDER)).alias("_first"))
    e = e.join(firsts, [*keys, "_sev"])
    # a first record without a ratio can't be outdone at its severity, a later one outdoes nothing
    dev = F.coalesce(F.abs(F.col("headwayRatio") - 1), F.when(F.struct(*ORDER) == F.col("_first"), F.lit(float("inf"))).otherwise(F.lit(-1.0)))
    rank = F.struct(F.col("_sev"), dev.alias("_dev"), (-F.coalesce(micros("emittedAt"), F.lit(-(1 << 62)))).alias("back"), (-F.col("recordId")).alias("back2"), F.col("status").alias("status"), F.col("headwayRatio").alias("ratio"))
    e = before(e.withColumn("_rank", rank), keys, ORDER, max_of={"_before": F.col("_rank")})
    return e.withColumn("_worst", F.greatest("_before", "_rank")).withColumn("worstBefore", F.col("_before.status")).drop("_first", "_rank", "_before")


def changes(records: DataFrame) -> DataFrame:
    """(recordId, headwayGroup, windowEnd, change) of every accepted record: OPENED, ESCALATED, CONTINUED, CLEARED or NONE."""
    s = segmented(accepted(records))
    change = (
        F.when(F.col("opens"), "OPENED").when(F.col("alert") & (F.col("_worst.status") != F.col("worstBefore")), "ESCALATED").when(F.col("alert"), "CONTINUED").when(F.col("clears"), "CLEARED").otherwise("NONE")
    )
    return s.select("recordId", "headwayGroup", "windowEnd", change.alias("change"))


def episodes(records: DataFrame, now=None) -> DataFrame:
    """One row per episode; endedAt is null while it is open. now: a column; open episodes silent for longer than the linger are closed."""
    s = keep(segmented(accepted(records)))
    seq = F.struct(*ORDER)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), seq))
    got = (
        s.filter("alert")
        .groupBy("headwayGroup", "episode")
        .agg(
            F.min_by("windowEnd", seq).alias("startedAt"),
            F.max("windowEnd").alias("lastSeenAt"),
            F.count("*").alias("windowsObserved"),
            F.max_by("status", seq).alias("status"),
            F.max_by("headwayRatio", seq).alias("ratio"),
            F.max("_worst").alias("_w"),
            F.max_by("minGapMetres", seq).alias("gapMetres"),
            last("expectedSpacingMetres").alias("expectedSpacingMetres"),
            last("scheduledHeadwaySeconds").alias("scheduledHeadwaySeconds"),
            last("worstPairVehicles").alias("vehicles"),
            last("routeShortName").alias("routeShortName"),
        )
    )
    ends = s.filter("clears").select("headwayGroup", "episode", F.col("windowEnd").alias("_end"))
    e = got.join(ends, ["headwayGroup", "episode"], "left")
    swept = F.lit(None).cast("timestamp_ntz") if now is None else F.when(F.col("lastSeenAt") < now - F.expr(f"interval {CONFIG.alert_linger}"), F.col("lastSeenAt"))
    e = e.withColumn("endedAt", F.coalesce("_end", swept))
    seconds = F.unix_seconds(F.coalesce("endedAt", "lastSeenAt").cast("timestamp")) - F.unix_seconds(F.col("startedAt").cast("timestamp"))
    return e.withColumns(
        {"episodeId": episode_id("headwayGroup", "startedAt"), "worstStatus": F.col("_w.status"), "worstRatio": F.col("_w.ratio"), "durationSeconds": seconds}
    ).drop("_w", "_end", "episode")
