"""Static GTFS: archive, CSV files by header name, and the tables made of them."""

from __future__ import annotations

import json
import logging
import os
import shutil
import tempfile
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from email.utils import formatdate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import times
from tramline.operators import resolve
from tramline.operators.schedule import speed  # noqa: F401

log = logging.getLogger(__name__)
REQUIRED = ("routes.txt", "trips.txt", "shapes.txt")
OPTIONAL = ("stop_times.txt", "calendar.txt", "calendar_dates.txt")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def stage(spark: SparkSession, archive: str, folder: str) -> dict[str, str]:
    """Unpack the files that are read into a folder that all executors share: file name -> path.

    Both are Hadoop paths (`file://`, `hdfs://`, `s3a://` or bare); bytes go from stream to stream in the driver's JVM.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source, to = path(archive), path(folder)
    fs = to.getFileSystem(conf)
    found = {}
    packed = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        while (entry := packed.getNextEntry()) is not None:
            name = entry.getName()
            if name in REQUIRED + OPTIONAL:
                out = fs.create(path(to, name), True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, out, 1 << 16, False)
                out.close()
                found[name] = f"{folder}/{name}"
    finally:
        packed.close()
    for n in REQUIRED:
        if n not in found:
            raise FileNotFoundError(f"{archive} has no {n}")
    return found


def read_csv(spark: SparkSession, path: str, columns: list[str], numbered: bool = False) -> DataFrame:
    """The named columns as trimmed strings; those the file lacks are null. A byte order mark is skipped. numbered adds feedRow, by which rows are in
    the order of the file however it is split: where the split begins, then the row in it."""
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", False).csv(path)
    have = {c.strip().lstrip("﻿"): c for c in r.columns}
    named = [F.trim(F.col(f"`{have[c]}`")).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("feedRow")
    return r.select(*named, *([place] if numbered else []))


def metres_of_km(c: Column) -> Column:
    """Metres of a text in kilometres; NaN for blank or rubbish."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(float("nan"))) * 1000


@dataclass
class Snapshot:
    """The static tables of one feed, read once per run."""

    routes: DataFrame  # routeId, shortName, longName, routeType, colorHex
    trips: DataFrame  # tripId, routeId, serviceId, directionId, shapeId, feedRow
    points: DataFrame  # shapeId, seq, lat, lon, dist_m, m
    lines: DataFrame  # shapeId, segments, shapeLengthMetres, pointCount
    calendar: DataFrame | None  # serviceId, days, start, end
    exceptions: DataFrame | None  # serviceId, date, exceptionType
    scheduled: DataFrame | None  # headwayGroup, tripId, serviceId, startSeconds, endSeconds, shapeLengthMetres


def load(spark: SparkSession, archive: str, folder: str) -> Snapshot:
    """Read an archive, unpacked to a shared folder. Where several rows have one id, the file's order tells which counts."""
    files = stage(spark, archive, folder)
    numbered = lambda n, cols: read_csv(spark, files[n], cols, numbered=True)
    routes = numbered("routes.txt", ["route_id", "route_short_name", "route_long_name", "route_type", "route_color"]).select(
        F.col("route_id").alias("routeId"), F.coalesce("route_short_name", F.lit("")).alias("shortName"), F.coalesce("route_long_name", F.lit("")).alias("longName"), times.lenient_int("route_type", -1).alias("routeType"), F.col("route_color").alias("colorHex"), "feedRow"
    )
    trips = numbered("trips.txt", ["trip_id", "route_id", "service_id", "direction_id", "shape_id"]).select(
        F.col("trip_id").alias("tripId"), F.col("route_id").alias("routeId"), F.col("service_id").alias("serviceId"), times.lenient_int("direction_id", -1).alias("directionId"), F.col("shape_id").alias("shapeId"), "feedRow"
    )
    usable = resolve.usable_trips(trips)
    points = resolve.shape_points(
        read_csv(spark, files["shapes.txt"], ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence", "shape_dist_traveled"]).select(
            F.col("shape_id").alias("shapeId"), times.lenient_int("shape_pt_sequence", 0).alias("seq"), F.col("shape_pt_lat").try_cast("double").alias("lat"), F.col("shape_pt_lon").try_cast("double").alias("lon"), metres_of_km(F.col("shape_dist_traveled")).alias("dist_m")
        )
    )
    lines = resolve.assemble(points)
    calendar = exceptions = scheduled = None
    if "calendar.txt" in files:
        calendar = read_csv(spark, files["calendar.txt"], ["service_id", *DAYS, "start_date", "end_date"]).select(F.col("service_id").alias("serviceId"), times.day_set(*DAYS).alias("days"), times.gtfs_date("start_date").alias("start"), times.gtfs_date("end_date").alias("end"))
    if "calendar_dates.txt" in files:
        exceptions = read_csv(spark, files["calendar_dates.txt"], ["service_id", "date", "exception_type"]).select(F.col("service_id").alias("serviceId"), times.gtfs_date("date").alias("date"), times.lenient_int("exception_type", 0).alias("exceptionType"))
    if "stop_times.txt" in files:
        stops = read_csv(spark, files["stop_times.txt"], ["trip_id", "stop_sequence", "departure_time", "arrival_time"])
        bounds = trip_bounds(
            stops.select(F.col("trip_id").alias("tripId"), times.lenient_int("stop_sequence", -1).alias("sequence"), F.when(times.gtfs_seconds("departure_time") >= 0, times.gtfs_seconds("departure_time")).otherwise(times.gtfs_seconds("arrival_time")).alias("second")).join(usable, "tripId", "left_semi")
        )
        scheduled = schedule_of(bounds, usable, lines, routes)
    return Snapshot(routes, usable, points, lines, calendar, exceptions, scheduled)


def trip_bounds(stops: DataFrame) -> DataFrame:
    """(tripId, startSeconds, endSeconds): the times at the lowest and highest sequence; rows without a sequence or time don't count."""
    at = F.struct("sequence", "second")
    return stops.filter("sequence >= 0 and second >= 0").groupBy("tripId").agg(F.min_by("second", at).alias("startSeconds"), F.max_by("second", F.struct("sequence", (-F.col("second")).alias("x"))).alias("endSeconds"))


def schedule_of(bounds: DataFrame, trips: DataFrame, lines: DataFrame, routes: DataFrame) -> DataFrame:
    """Scheduled trips that end after they start and have a shape and a named route."""
    named = routes.filter("shortName <> ''").select("routeId", "shortName")
    return (
        bounds.filter("endSeconds > startSeconds").join(trips, "tripId").join(lines.select("shapeId", "shapeLengthMetres"), "shapeId").join(named, "routeId")
        .select(F.concat_ws(":", "shortName", F.col("directionId").cast("string")).alias("headwayGroup"), "tripId", "serviceId", "startSeconds", "endSeconds", "shapeLengthMetres")
    )


def fetch(url: str, to: str, opener=urllib.request.urlopen) -> str:
    """Download to `to` unless it hasn't changed since; returns fresh, unchanged or stale (failed, but a copy is there)."""
    stamp = to + ".stamp"
    request = urllib.request.Request(url)
    if os.path.exists(to) and os.path.exists(stamp):
        with open(stamp) as f:
            request.add_header("If-Modified-Since", json.load(f)["modified"])
    try:
        with opener(request) as answer:
            if getattr(answer, "status", 200) == 304:
                return "unchanged"
            with tempfile.NamedTemporaryFile(dir=os.path.dirname(to) or ".", delete=False) as part:
                shutil.copyfileobj(answer, part)
            os.replace(part.name, to)
            modified = answer.headers.get("Last-Modified") or formatdate(time.time(), usegmt=True)
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return "unchanged"
        if os.path.exists(to):
            return "stale"
        raise
    except OSError:
        if os.path.exists(to):
            return "stale"
        raise
    with open(stamp, "w") as f:
        json.dump({"modified": modified}, f)
    return "fresh"


class SnapshotCache:
    """One snapshot, loaded again when older than refresh_s; a failed reload keeps the old one until expire_s."""

    def __init__(self, loader, refresh_s: float = 6 * 3600, expire_s: float = 24 * 3600, clock=time.monotonic):
        self.loader, self.refresh_s, self.expire_s, self.clock = loader, refresh_s, expire_s, clock
        self.value, self.at = None, 0.0

    def get(self):
        age = self.clock() - self.at
        if self.value is None or age >= self.expire_s:
            self.value, self.at = self.loader(), self.clock()
        elif age >= self.refresh_s:
            try:
                self.value, self.at = self.loader(), self.clock()
            except Exception:  # noqa: BLE001 - any failed reload keeps what there is
                log.warning("the snapshot could not be loaded again; the one of %.0f s ago stays", age, exc_info=True)
        return self.value

    def invalidate(self) -> None:
        self.value = None
