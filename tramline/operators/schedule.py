"""The timetable: active services, scheduled headways, expected spacing.

Scheduled trips are rows (headwayGroup, tripId, serviceId, startSeconds, endSeconds, shapeLengthMetres), times in
seconds of the service day, which may pass 24 hours; there is no wrap at midnight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions import arrays
from tramline.functions.times import runs_on


def speed(start: Column, end: Column, length: Column) -> Column:
    """Average metres a second of a trip; its duration counts as 1 s at least."""
    return length / F.greatest(F.lit(1), end - start)


def service_days(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, calendar row) of the dates within a row's start and end: rows become one per date, cut to the span of `dates`, and meet them by equality."""
    lo, hi = dates.agg(F.min("date"), F.max("date")).first()
    from_, to = F.greatest(F.col("start"), F.lit(lo).cast("date")), F.least(F.col("end"), F.lit(hi).cast("date"))
    days = calendar.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & (from_ <= to)).withColumn("date", F.explode(F.sequence(from_, to)))
    return dates.distinct().join(days, "date")


def active_services(dates: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(date, serviceId): weekly services of the date and added ones, without removed ones.

    calendar: serviceId, days (0 = Monday), start, end; exceptions: serviceId, date, exceptionType (1 adds, 2 removes).
    """
    weekly = service_days(dates, calendar).filter(runs_on(F.col("date"), F.col("days"), F.col("start"), F.col("end"))).select("date", "serviceId")
    added = exceptions.filter("exceptionType = 1").join(dates, "date", "left_semi").select("date", "serviceId")
    removed = exceptions.filter("exceptionType = 2").select("date", "serviceId")
    return weekly.union(added).distinct().join(removed, ["date", "serviceId"], "left_anti")


def covered(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, covered): whether any weekly service is valid on the date; true for every date if there is none."""
    if calendar.isEmpty():
        return dates.select("date", F.lit(True).alias("covered"))
    on = service_days(dates, calendar).select("date").distinct().withColumn("_on", F.lit(True))
    return dates.distinct().join(on, "date", "left").select("date", F.coalesce("_on", F.lit(False)).alias("covered"))


def scheduled_headways(moments: DataFrame, trips: DataFrame, active: DataFrame | None) -> DataFrame:
    """moments (headwayGroup, date, second) with scheduledHeadwaySeconds, averageSpeedMps, tripsConsidered.

    Trips of the group within the half window of the second and, unless `active` is None (no calendar at all),
    of a service active on the date. At least two trips and one gap above 0 are needed, else no row. Medians
    are the upper ones. Trips meet moments in buckets of the half window, three to a moment.
    """
    half = CONFIG.schedule_half_window_s
    m = moments.select("headwayGroup", "date", "second").distinct()
    m = m.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("second") / half) + k)))
    t = trips.withColumn("_bucket", F.floor(F.col("startSeconds") / half))
    near = m.join(t, ["headwayGroup", "_bucket"]).filter(F.abs(F.col("startSeconds") - F.col("second")) <= half)
    if active is not None:
        near = near.join(active.withColumnRenamed("date", "_date"), (F.col("date") == F.col("_date")) & (near["serviceId"] == active["serviceId"]), "left_semi")
    keys = ["headwayGroup", "date", "second"]
    w = Window.partitionBy(*keys).orderBy("startSeconds")
    gap = F.col("startSeconds") - F.lag("startSeconds").over(w)
    pace = F.when(F.col("shapeLengthMetres") > 0, speed(F.col("startSeconds"), F.col("endSeconds"), F.col("shapeLengthMetres")))
    # one row a trip of a group within 1.5 hours: what is collected is bounded by the timetable
    got = near.withColumns({"_gap": gap, "_pace": pace}).groupBy(*keys).agg(
        F.count("*").cast("int").alias("tripsConsidered"),
        arrays.upper_median(F.collect_list(F.when(F.col("_gap") > 0, F.col("_gap")))).alias("scheduledHeadwaySeconds"),
        arrays.upper_median(F.collect_list("_pace")).alias("averageSpeedMps"),
    )
    return got.filter("tripsConsidered >= 2 and scheduledHeadwaySeconds is not null and averageSpeedMps is not null")


def timetable(trips: DataFrame) -> DataFrame:
    """One row per group with its trips as an array in order of start, for lookups inside a stream."""
    trip = F.struct("startSeconds", "endSeconds", "serviceId", "shapeLengthMetres")
    return trips.groupBy("headwayGroup").agg(F.sort_array(F.collect_list(trip)).alias("timetable"))


def scheduled_from_array(trips: Column, second: Column, services: Column | None) -> Column:
    """struct(scheduledHeadwaySeconds, averageSpeedMps) from a timetable array; null where there is none."""
    half = CONFIG.schedule_half_window_s
    on = (lambda t: F.array_contains(services, t["serviceId"])) if services is not None else (lambda t: F.lit(True))
    near = F.filter(trips, lambda t: (F.abs(t["startSeconds"] - second) <= half) & on(t))
    steps = F.filter(arrays.differences(F.transform(near, lambda t: t["startSeconds"])), lambda g: g > 0)
    paces = F.transform(F.filter(near, lambda t: t["shapeLengthMetres"] > 0), lambda t: speed(t["startSeconds"], t["endSeconds"], t["shapeLengthMetres"]))
    ok = (F.size(near) >= 2) & (F.size(steps) > 0) & (F.size(paces) > 0)
    return F.when(ok, F.struct(arrays.upper_median(steps).alias("scheduledHeadwaySeconds"), arrays.upper_median(paces).alias("averageSpeedMps")))
