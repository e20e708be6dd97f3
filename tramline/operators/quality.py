"""Reports on how well pings resolve and how true projections are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions.folds import before
from tramline.functions.ids import bare, micros
from tramline.functions.medians import grouped_ranks
from tramline.operators import resolve, snap
from tramline.session import keep, one_row


def coverage(pings: DataFrame, trips: DataFrame, shapes: DataFrame, routes: DataFrame) -> DataFrame:
    """pings with outcome and tripDirection: resolved, or the first thing that is missing."""
    t = resolve.usable_trips(trips).select(F.col("tripId").alias("_t"), F.col("routeId").alias("_r"), F.col("shapeId").alias("_s"), F.col("directionId").alias("tripDirection"))
    have = resolve.polylines(shapes).select(F.col("shapeId").alias("_s"), F.lit(True).alias("_shape"))
    named = routes.select(F.col("routeId").alias("_r"), F.lit(True).alias("_route"))
    short = resolve.first_by_short_name(routes, "routeId").select(F.col("shortName").alias("_n"), F.lit(True).alias("_named"))
    side = resolve.small_side(t.join(have, "_s", "left").join(named, "_r", "left"), resolve.MAX_TRIPS)
    k = F.when(bare("tripId") != "", bare("tripId"))
    j = pings.withColumn("_k", k).join(side, F.col("_k") == F.col("_t"), "left")
    j = j.join(resolve.small_side(short, resolve.MAX_TRIPS), F.col("routeId") == F.col("_n"), "left")
    outcome = (
        F.when(F.col("_k").isNull(), "no trip id").when(F.col("_t").isNull(), "unknown trip").when(F.col("_shape").isNull(), "no shape").when(F.col("_route").isNull() & F.col("_named").isNull(), "unknown route").otherwise("resolved")
    )
    return j.withColumn("outcome", outcome).drop("_k", "_t", "_s", "_r", "_shape", "_route", "_n", "_named")


def percentages(outcomes: DataFrame) -> DataFrame:
    """(total, resolved, percent); 0 percent of nothing."""
    return outcomes.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "resolved").alias("resolved")).withColumn("percent", F.coalesce(F.try_divide(F.col("resolved") * 100.0, "total"), F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; 0 where either side doesn't vary or there is no pair."""
    r = F.corr(x, y)
    return F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, one column per point): the least value that at least that share of the key's values doesn't exceed. By histograms, so
    that a key, or the whole table without keys, may hold any number of different values."""
    counts = rows.filter(F.col(value).isNotNull()).select(*keys, value, F.lit(1).cast("long").alias("n"))
    ranks = {c: f"greatest(0L, cast(ceil({p} * _all) as bigint) - 1)" for c, p in points.items()}
    return grouped_ranks(counts, keys, value, ranks, "_n").drop("_n")


def moving_pairs(projections: DataFrame, keys: list[str]) -> DataFrame:
    """Successive projections of a source with seconds, deltaMetres and impliedMps; pairs on other shapes or under 5 s apart are left out."""
    lag = {"beforeId": F.col("projectionId"), "_shape": F.col("shapeId"), "_at": micros("timestamp"), "_along": F.col("distanceAlongRouteMetres")}
    p = before(projections, keys, ["timestamp", "projectionId"], lag_of=lag)
    p = p.withColumns({"seconds": (micros("timestamp") - F.col("_at")) / 1e6, "deltaMetres": F.col("distanceAlongRouteMetres") - F.col("_along")})
    kept = p.filter((F.col("_shape") == F.col("shapeId")) & (F.col("seconds") >= 5)).withColumn("impliedMps", F.try_divide("deltaMetres", "seconds"))
    return kept.withColumns({"backward": F.col("deltaMetres") < -20, "absurd": F.abs("impliedMps") > 35}).drop("_shape", "_at", "_along")


def accuracy(pairs: DataFrame, reported: str) -> DataFrame:
    """One row: pairs, mean implied and reported speed, error percentiles, correlation, verdict."""
    p = keep(pairs.filter(F.col(reported).isNotNull() & ~F.isnan(reported)).select("impliedMps", F.col(reported).alias("reported"), F.abs(F.col("impliedMps") - F.col(reported)).alias("_error")))
    sums = p.agg(F.count("*").alias("pairs"), F.avg("impliedMps").alias("mean_implied"), F.avg("reported").alias("mean_reported"), F.max("_error").alias("worst"), pearson(F.col("impliedMps"), F.col("reported")).alias("r"))
    a = one_row(sums, nearest_ranks(p, [], "_error", {"p50": 0.5, "p90": 0.9}))
    ok = (F.col("r") > 0.7) & (F.abs(F.col("mean_implied") - F.col("mean_reported")) < 3)
    told = a.withColumn("verdict", F.when(F.col("pairs") < 5, "too few").when(ok, "agree").otherwise("disagree"))
    return told.select("pairs", "mean_implied", "mean_reported", "p50", "p90", "worst", "r", "verdict")


def self_consistency(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Every `vertex_stride`th vertex projected on its own line: one row of errors, ambiguous vertices and those a hint doesn't settle.

    lines: polylines with their pointCount.
    """
    c = CONFIG
    w = Window.partitionBy("shapeId").orderBy("seq")  # a shape's points are what one array holds
    v = points.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % c.vertex_stride == 0).select("shapeId", "lat", "lon", "m")
    found = ["distanceAlongRouteMetres", "crossTrackMetres"]
    free = snap.snap(v, lines, "shapeId", "lat", "lon").select("shapeId", "lat", "lon", "m", *[F.col(f).alias(f"_{f}") for f in found])
    both = snap.snap(free, lines, "shapeId", "lat", "lon", hint="m", window=c.vertex_hint_m).filter("segmentIndex is not null")
    v = both.withColumns({"_e": F.abs(F.col("_distanceAlongRouteMetres") - F.col("m")), "_he": F.abs(F.col("distanceAlongRouteMetres") - F.col("m"))})
    bad = F.col("_e") > c.ambiguous_m
    return v.agg(
        F.count("*").alias("checked"), F.max("_e").alias("worst_along"), F.max("_crossTrackMetres").alias("worst_cross"), F.count_if(bad).alias("ambiguous"), F.count_distinct(F.when(bad, F.col("shapeId"))).alias("shapes"), F.count_if(bad & (F.col("_he") > c.ambiguous_m)).alias("hinted_failures")
    )
