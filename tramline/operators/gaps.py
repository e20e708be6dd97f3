"""Gaps between vehicles along a route: relational for batches, by arrays for streams; both give the same.

Sightings are rows (keys, vehicleId, distanceMetres, ts). How far a vehicle moved is taken over all its
sightings, where it is from the newest; at one time the smaller distance counts. Vehicles that hardly moved at
an end of the route are on layover and stand aside. The rest are ordered by distance, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions import arrays


def is_layover(moved: Column, at: Column, length: Column) -> Column:
    """False where the route's length is unknown (null, NaN) or not positive."""
    c = CONFIG
    ends = (at <= c.terminal_m) | (at >= length - c.terminal_m)
    return F.coalesce((length > 0) & ~F.isnan(length) & (moved < c.stationary_m) & ends, F.lit(False))


def newest(sightings: DataFrame, keys: list[str], length: Column | None = None) -> DataFrame:
    """(keys, vehicleId, distanceMetres, movedMetres, lengthMetres): one row per vehicle. Null distances are no sightings."""
    order = F.struct(F.col("ts"), -F.col("distanceMetres"))
    return (
        sightings.filter("distanceMetres is not null and vehicleId is not null")
        .groupBy(*keys, "vehicleId")
        .agg(
            F.max_by("distanceMetres", order).alias("distanceMetres"),
            (F.max("distanceMetres") - F.min("distanceMetres")).alias("movedMetres"),
            F.max(length if length is not None else F.lit(None).cast("double")).alias("lengthMetres"),
        )
    )


def neighbour_gaps(placed: DataFrame, keys: list[str]) -> DataFrame:
    """placed with gapMetres to the vehicle before; null for the first."""
    w = Window.partitionBy(*keys).orderBy("distanceMetres", "vehicleId")
    return placed.withColumn("gapMetres", F.col("distanceMetres") - F.lag("distanceMetres").over(w))


def gap_statistics(gapped: DataFrame, keys: list[str]) -> DataFrame:
    return gapped.groupBy(*keys).agg(
        F.count("*").cast("int").alias("vehicleCount"),
        F.min("gapMetres").alias("minGapMetres"),
        F.percentile("gapMetres", 0.5).alias("medianGapMetres"),
        F.max("gapMetres").alias("maxGapMetres"),
        F.avg("gapMetres").alias("meanGapMetres"),
    )


def gaps(sightings: DataFrame, keys: list[str], length: Column | None = None) -> DataFrame:
    """Relational form: statistics, ordered arrays, layovers and worst pair per key.

    Groups hold one row per vehicle of a window when they are collected, which bounds the arrays by the fleet.
    """
    # the route's length is the group's, as any of its sightings has it
    n = newest(sightings, keys, length)
    w = Window.partitionBy(*keys)
    placed = n.withColumn("lengthMetres", F.max("lengthMetres").over(w)).withColumn("away", is_layover(F.col("movedMetres"), F.col("distanceMetres"), F.col("lengthMetres")))
    moving = F.when(~F.col("away"), F.struct("distanceMetres", "vehicleId"))
    grouped = placed.groupBy(*keys).agg(
        F.max("lengthMetres").alias("routeLengthMetres"),
        F.sort_array(F.collect_list(moving)).alias("_o"),
        F.sort_array(F.collect_list(F.when(F.col("away"), F.col("vehicleId")))).alias("layoverVehicles"),
    )
    return from_ordered(grouped)


def from_ordered(grouped: DataFrame) -> DataFrame:
    """Adds what follows from _o, the ordered array of (distanceMetres, vehicleId)."""
    d = grouped.withColumns({"orderedVehicles": F.col("_o.vehicleId"), "orderedDistancesMetres": F.col("_o.distanceMetres"), "vehicleCount": F.size("_o")})
    g = d.withColumn("gapsMetres", arrays.differences(F.col("orderedDistancesMetres")))
    x = F.col("gapsMetres")
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return g.withColumns(
        {
            "minGapMetres": F.array_min(x),
            "medianGapMetres": arrays.median(x),
            "maxGapMetres": F.array_max(x),
            "meanGapMetres": F.try_divide(total, F.size(x)),
            "worstPairVehicles": arrays.least_pair(x, F.col("orderedVehicles")),
        }
    ).drop("_o")


def gaps_from_array(grouped: DataFrame, sightings: str = "sightings", length: str = "routeLengthMetres") -> DataFrame:
    """Array form of `gaps`, without an aggregation of its own: sightings is array<struct<vehicleId, distanceMetres, ts>>."""
    seen = F.filter(F.col(sightings), lambda s: s["distanceMetres"].isNotNull() & s["vehicleId"].isNotNull())
    ids = F.array_sort(F.array_distinct(F.transform(F.col("_s"), lambda s: s["vehicleId"])))

    def one(v: Column) -> Column:
        own = F.filter(F.col("_s"), lambda s: s["vehicleId"] == v)
        at = F.array_max(F.transform(own, lambda s: F.struct(s["ts"].alias("ts"), (-s["distanceMetres"]).alias("d"))))
        ds = F.transform(own, lambda s: s["distanceMetres"])
        return F.struct((-at["d"]).alias("distanceMetres"), v.alias("vehicleId"), (F.array_max(ds) - F.array_min(ds)).alias("moved"))

    placed = grouped.withColumn("_s", seen).withColumn("_v", F.transform(ids, one))
    away = lambda v: is_layover(v["moved"], v["distanceMetres"], F.col(length))
    return from_ordered(
        placed.withColumns(
            {
                "_o": F.sort_array(F.transform(F.filter("_v", lambda v: ~away(v)), lambda v: F.struct(v["distanceMetres"].alias("distanceMetres"), v["vehicleId"].alias("vehicleId")))),
                "layoverVehicles": F.transform(F.filter("_v", away), lambda v: v["vehicleId"]),
            }
        ).drop("_s", "_v")
    )
