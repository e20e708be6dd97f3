"""The window records: pings to gaps, gaps to status. One definition for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions import times
from tramline.functions.status import from_ratio
from tramline.operators import gaps, resolve, schedule, snap
from tramline.schema import RECORD
from tramline.session import keep, small_side

#: Most groups' timetables, and most dates, that are broadcast.
MAX_GROUPS, MAX_DATES = 20_000, 100_000

KEYS = ["windowStart", "windowEnd", "headwayGroup", "routeShortName", "routeLongName", "directionId"]


def project(pings: DataFrame, trips: DataFrame, shapes: DataFrame, routes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Resolved pings with their place along the trip's shape; pings too far from it are left out, as are those without vehicle, trip or position.

    lines: the shapes' polylines, if they are assembled already.
    """
    lines = keep(resolve.polylines(shapes)) if lines is None else lines  # a static table that three steps read
    known = resolve.resolve(pings.filter("vehicleId is not null and tripId is not null"), trips, shapes, routes, lines)
    placed = snap.snap(known, lines)
    return placed.filter(F.col("crossTrackMetres") <= CONFIG.max_cross_track_m)  # null and NaN are no distances


def windowed(projected: DataFrame) -> DataFrame:
    """Sightings (keys, vehicleId, distanceMetres, ts, shapeLengthMetres): each in every window that it falls in."""
    return projected.select(
        F.window("ts", CONFIG.window, CONFIG.slide).alias("w"), "headwayGroup", "routeShortName", "routeLongName", F.col("tripDirection").alias("directionId"), "vehicleId", F.col("distanceAlongRouteMetres").alias("distanceMetres"), "ts", "shapeLengthMetres"
    ).select(F.col("w.start").alias("windowStart"), F.col("w.end").alias("windowEnd"), *KEYS[2:], "vehicleId", "distanceMetres", "ts", "shapeLengthMetres")


def classified(records: DataFrame) -> DataFrame:
    """records with what follows from gaps and schedule. Only the least gap is judged; fewer than two moving vehicles are a layover, if any stand aside."""
    spacing = F.col("scheduledHeadwaySeconds") * F.col("averageSpeedMps")
    r = records.withColumn("expectedSpacingMetres", spacing)
    has = F.col("minGapMetres").isNotNull() & (F.col("expectedSpacingMetres") > 0)
    r = r.withColumns(
        {
            "observedHeadwaySeconds": F.when(F.col("scheduledHeadwaySeconds").isNotNull(), F.try_divide("minGapMetres", "averageSpeedMps")),
            "headwayRatio": F.when(has, F.try_divide("minGapMetres", "expectedSpacingMetres")),
        }
    )
    alone = (F.col("vehicleCount") < 2) & (F.size("layoverVehicles") > 0)
    r = r.withColumn("status", F.when(alone, "LAYOVER").otherwise(from_ratio("headwayRatio")))
    return r.withColumn("worstPairVehicles", F.when(F.col("headwayRatio").isNotNull(), F.col("worstPairVehicles")))


def in_order(records: DataFrame) -> DataFrame:
    return records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields])


def moment(end: Column | str) -> tuple[Column, Column]:
    """Agency date and second of day of a window's end."""
    x = times.local(end, CONFIG.zone)
    return F.to_date(x), times.second_of_day(x)


def batch_records(projected: DataFrame, trips: DataFrame, active: DataFrame | None) -> DataFrame:
    """Relational form: one row per window and group with any vehicle. trips: the timetable's rows."""
    g = gaps.gaps(windowed(projected), KEYS, F.col("shapeLengthMetres"))
    date, second = moment("windowEnd")
    g = g.withColumns({"date": date, "second": second})
    found = schedule.scheduled_headways(g, trips, active)
    return in_order(classified(g.join(found, ["headwayGroup", "date", "second"], "left")))


def stream_records(projected: DataFrame, timetable: DataFrame, services: DataFrame | None) -> DataFrame:
    """Array form, for streams: a single aggregation, everything after it row by row.

    timetable: one row per group (schedule.timetable); services: date, services (array), or None without a calendar.
    """
    w = windowed(projected).groupBy(*KEYS).agg(F.collect_list(F.struct("vehicleId", "distanceMetres", "ts")).alias("sightings"), F.max("shapeLengthMetres").alias("routeLengthMetres"))
    g = gaps.gaps_from_array(w)
    date, second = moment("windowEnd")
    g = g.withColumns({"_date": date, "_second": second}).join(small_side(timetable, MAX_GROUPS), "headwayGroup", "left")
    on = None
    if services is not None:
        g = g.join(small_side(services.withColumnRenamed("date", "_d"), MAX_DATES), F.col("_date") == F.col("_d"), "left")
        on = F.coalesce("services", F.array().cast("array<string>"))
    g = g.withColumn("_s", schedule.scheduled_from_array(F.coalesce(F.col("timetable"), F.array().cast(timetable.schema["timetable"].dataType)), F.col("_second"), on))
    return in_order(classified(g.withColumns({"scheduledHeadwaySeconds": F.col("_s.scheduledHeadwaySeconds"), "averageSpeedMps": F.col("_s.averageSpeedMps")})))
