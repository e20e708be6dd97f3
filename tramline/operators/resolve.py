"""From a ping to its trip, shape and route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine, segments
from tramline.functions.ids import bare
from tramline.session import small_side

#: Rows of the static tables that may be broadcast.
MAX_TRIPS, MAX_SHAPES = 500_000, 5_000


def usable_trips(trips: DataFrame, order: str = "feedRow", keep_order: bool = False) -> DataFrame:
    """(tripId, routeId, serviceId, directionId, shapeId), one row per trip: the last of those with a shape and direction 0 or 1."""
    w = Window.partitionBy("tripId").orderBy(F.desc(order))
    got = (
        trips.select(bare("tripId").alias("tripId"), "routeId", "serviceId", "directionId", bare("shapeId").alias("shapeId"), order)
        .filter("tripId <> '' and shapeId <> '' and directionId in (0, 1)")
        .withColumn("_n", F.row_number().over(w))
        .filter("_n = 1")
        .drop("_n")
    )
    return got if keep_order else got.drop(order)


def first_by_short_name(routes: DataFrame, order: str) -> DataFrame:
    """routes with one row per short name: the first."""
    w = Window.partitionBy("shortName").orderBy(order)
    return routes.filter("shortName <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def shape_points(points: DataFrame) -> DataFrame:
    """points (shapeId, seq, lat, lon, dist_m) with m, the metres from the start: dist_m, or the way along
    great circles for every shape that has a null, NaN or falling dist_m anywhere."""
    w = Window.partitionBy("shapeId").orderBy("seq")
    step = F.coalesce(haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    odd = F.col("dist_m").isNull() | F.isnan("dist_m") | F.coalesce(F.col("dist_m") < F.lag("dist_m").over(w), F.lit(False))
    return (
        points.withColumns({"_step": step, "_odd": odd})
        .withColumns({"_way": F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_any": F.max("_odd").over(Window.partitionBy("shapeId"))})
        .withColumn("m", F.when(F.col("_any"), F.col("_way")).otherwise(F.col("dist_m")))
        .drop("_step", "_odd", "_way", "_any")
    )


def polylines(shapes: DataFrame) -> DataFrame:
    """(shapeId, segments, shapeLengthMetres, pointCount) of shapes (shapeId, pts) with two points or more."""
    points = shapes.select(bare("shapeId").alias("shapeId"), F.explode("pts").alias("p")).select("shapeId", "p.*")
    return assemble(shape_points(points))


def assemble(points: DataFrame) -> DataFrame:
    """Polylines of points (shapeId, seq, lat, lon, m); a shape's points are what one array holds."""
    got = points.groupBy("shapeId").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon", "m"))).alias("pts")).filter(F.size("pts") >= 2)
    return got.select("shapeId", segments(F.col("pts")).alias("segments"), F.element_at("pts", -1)["m"].alias("shapeLengthMetres"), F.size("pts").alias("pointCount"))


def contexts(trips: DataFrame, shapes: DataFrame, routes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(tripId, shapeId, serviceId, directionId, static route columns, shapeLengthMetres): trips that have a shape; the route may be missing."""
    r = routes.select("routeId", "shortName", "longName")
    lengths = (polylines(shapes) if lines is None else lines).select("shapeId", "shapeLengthMetres")
    return usable_trips(trips).join(lengths, "shapeId").join(r, "routeId", "left")


def resolve(pings: DataFrame, trips: DataFrame, shapes: DataFrame, routes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """pings with headwayGroup, routeShortName, routeLongName, tripDirection, tripShape, shapeLengthMetres.

    The trip's own route counts; if the feed lacks it, the route whose short name the ping carries. Pings whose
    trip, shape or route can't be found are left out. Dimension tables are broadcast only below a counted size.
    """
    by_name = first_by_short_name(routes, "routeId").select(F.col("shortName").alias("_short"), F.col("longName").alias("_long"))
    ctx = contexts(trips, shapes, routes, lines).select(
        F.col("tripId").alias("_trip"), F.col("shapeId").alias("tripShape"), F.col("directionId").alias("tripDirection"), F.col("shortName").alias("_s1"), F.col("longName").alias("_l1"), "shapeLengthMetres"
    )
    found = pings.join(small_side(ctx, MAX_TRIPS), bare(pings["tripId"]) == F.col("_trip"))
    named = found.join(small_side(by_name, MAX_TRIPS), F.col("routeId") == F.col("_short"), "left")
    return (
        named.withColumns({"routeShortName": F.coalesce("_s1", "_short"), "routeLongName": F.when(F.col("_s1").isNotNull(), F.col("_l1")).otherwise(F.col("_long"))})
        .filter("routeShortName is not null")
        .withColumn("headwayGroup", F.concat_ws(":", "routeShortName", F.col("tripDirection").cast("string")))
        .drop("_trip", "_s1", "_l1", "_short", "_long")
    )
