"""Queries of the feed, log, sink and stream operators: each runs its operator over a whole table and gives what came out."""

from __future__ import annotations

import os

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline import schema
from tramline.config import CONFIG
from tramline.functions import ids
from tramline.plans import flows
from tramline.plans.registry import Registry
from tramline.operators import schedule
from tramline.plans.transit import ALERT_SQL, RH, ROUTES, SHAPES, TRIPS, VP
from tramline.session import fresh, one_row
from tramline.sources import feed, gtfs, pings
from tramline.streaming import sinks, spacing

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query


def as_pings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.PING.fields])


#: Entities of one feed message.
ENTITIES = 500


@query(
    "src_2",
    """SELECT deliveryId, vehicleId, routeId, nullif(tripId, '') AS tripId, directionId, round(CAST(CAST(latitude AS FLOAT) AS DOUBLE), 4) AS latitude, CAST(floor(epoch("timestamp")) AS BIGINT) AS second
  FROM vehicle_positions WHERE routeId <> '' AND vehicleId <> '' AND latitude IS NOT NULL AND longitude IS NOT NULL""",
)
def feed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every ping as an entity of a feed message, decoded again."""

    def run(frames):
        import pandas as pd

        columns = ["vehicleId", "routeId", "tripId", "directionId", "latitude", "timestamp"]
        for f in frames:
            # only entities with a position, a route and a vehicle come out of a message, in its order
            f = f[f["vehicleId"].fillna("").ne("") & f["routeId"].fillna("").ne("") & f["latitude"].notna() & f["longitude"].notna()]
            for k in range(0, len(f), ENTITIES):
                part = f.iloc[k : k + ENTITIES]
                got = feed.decode(feed.encode(part.drop(columns="deliveryId").to_dict("records")))
                yield pd.DataFrame([{c: p[c] for c in columns} for p in got], columns=columns).assign(deliveryId=part["deliveryId"].to_numpy()).astype({"directionId": "Int32", "timestamp": "Int64"})

    v = VP(spark, d).select("deliveryId", "vehicleId", "routeId", "tripId", "directionId", "latitude", "longitude", "bearingDegrees", "speedMetersPerSecond", ids.seconds("timestamp").alias("timestamp"))
    got = v.mapInPandas(run, "deliveryId long, vehicleId string, routeId string, tripId string, directionId int, latitude double, timestamp long")
    return got.select("deliveryId", "vehicleId", "routeId", "tripId", "directionId", F.round("latitude", 4).alias("latitude"), F.col("timestamp").alias("second"))


@query("snk_1", """SELECT vehicleId, tripId, "timestamp" FROM vehicle_positions WHERE vehicleId IS NOT NULL AND tripId IS NOT NULL""")
def published(spark: SparkSession, d: str) -> DataFrame:
    """Published to a folder of JSON lines and read back as the log."""
    to = fresh(spark, "log")
    pings.publish(as_pings(VP(spark, d)), {"kind": "files", "path": to})
    return pings.parse_pings(spark.read.text(to)).select("vehicleId", "tripId", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("src_8", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT vehicleId) AS BIGINT) AS vehicles FROM vehicle_positions WHERE vehicleId IS NOT NULL AND tripId IS NOT NULL""")
def log_scan(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream, drained."""
    log, out = fresh(spark, "log"), fresh(spark, "drained")
    pings.publish(as_pings(VP(spark, d)), {"kind": "files", "path": log})
    rows = pings.parse_pings(pings.log_stream(spark, {"kind": "files", "path": log, "per_trigger": 1000}))
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.count_distinct("vehicleId").alias("vehicles"))


SLICES, WATERMARK_SLICES = 6, 24
_SLICE_SQL = f"s AS (SELECT *, CAST(least({SLICES - 1}, floor((batchId - (SELECT min(batchId) FROM vehicle_positions)) * {SLICES} / ((SELECT max(batchId) - min(batchId) + 1 FROM vehicle_positions)))) AS BIGINT) AS slice FROM vehicle_positions)"


def slices(v: DataFrame, count: int = SLICES) -> tuple[list[DataFrame], int]:
    """The log in parts of equal spans of polls, and the number of files that each is written as."""
    lo, hi, n = v.agg(F.min("batchId"), F.max("batchId"), F.count("*")).first()
    files = max(1, min(v.sparkSession.sparkContext.defaultParallelism, n // (2000 * count)))
    at = F.least(F.lit(count - 1), F.floor((F.col("batchId") - lo) * count / (hi - lo + 1)))
    return [v.filter(at == k).repartition(files) for k in range(count)], files


def drained(rows: DataFrame, checkpoint: str, batch) -> int:
    """Run `batch` on all micro-batches that there are; the number of the last one. What it raises comes out."""
    q = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return -1 if q.lastProgress is None else q.lastProgress["batchId"]


@query("st_11", f"""WITH {_SLICE_SQL} SELECT slice AS batch, CAST(count(*) AS BIGINT) AS n FROM s WHERE vehicleId IS NOT NULL AND tripId IS NOT NULL GROUP BY 1""")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """A log that is there as a whole, taken a slice at a time: the rows of every micro-batch."""
    parts, files = slices(VP(spark, d))
    log, out = fresh(spark, "log"), fresh(spark, "drained")
    for p in parts:
        pings.publish(as_pings(p), {"kind": "files", "path": log})
    rows = pings.parse_pings(pings.log_stream(spark, {"kind": "files", "path": log, "per_trigger": files}))
    drained(rows, out + "-cp", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


class Broken(Exception):
    pass


@query("snk_7", f"""WITH {_SLICE_SQL} SELECT CASE WHEN slice < {SLICES // 2} THEN 'first' ELSE 'again' END AS run, CAST(count(*) AS BIGINT) AS n FROM s WHERE vehicleId IS NOT NULL AND tripId IS NOT NULL GROUP BY 1""")
def restarted(spark: SparkSession, d: str) -> DataFrame:
    """A query that is stopped, breaks after it has written a batch, and goes on from its checkpoint: every ping once."""
    parts, files = slices(VP(spark, d))
    log, out = fresh(spark, "log"), fresh(spark, "drained")
    source = {"kind": "files", "path": log, "per_trigger": files}
    broken = []

    def write(run: str, breaks: bool = False):
        def batch(b: DataFrame, n: int) -> None:
            b.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{out}/batch={n}")
            if breaks and not broken:
                broken.append(n)
                raise Broken(f"batch {n}")

        return batch

    def go(batch) -> None:
        drained(pings.parse_pings(pings.log_stream(spark, source)), out + "-cp", batch)

    for p in parts[: SLICES // 2]:
        pings.publish(as_pings(p), {"kind": "files", "path": log})
    go(write("first"))
    for p in parts[SLICES // 2 :]:
        pings.publish(as_pings(p), {"kind": "files", "path": log})
    try:
        go(write("broken", breaks=True))
    except StreamingQueryException:
        go(write("again"))  # the broken batch runs again under its number and replaces what it wrote
    return spark.read.parquet(out).groupBy("run").agg(F.count("*").alias("n"))


# The watermark by which a micro-batch refuses rows is the one that the batch before it started with.
_WATERMARK_SQL = f"""{_SLICE_SQL.replace(f"least({SLICES - 1},", f"least({WATERMARK_SLICES - 1},").replace(f"* {SLICES} /", f"* {WATERMARK_SLICES} /")}, tops AS (SELECT slice, max("timestamp") AS top FROM s GROUP BY 1),
  marks AS (SELECT slice, date_trunc('millisecond', max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) - INTERVAL 2 MINUTE AS mark FROM tops),
  w AS (SELECT slice, unnest([b, b - INTERVAL 30 SECOND]) AS windowStart FROM (SELECT slice, time_bucket(INTERVAL 30 SECOND, "timestamp", TIMESTAMP '1970-01-01') AS b FROM s WHERE "timestamp" IS NOT NULL)),
  kept AS (SELECT windowStart, (mark IS NULL OR windowStart + INTERVAL 60 SECOND > mark) AS ok FROM w JOIN marks ON w.slice = marks.slice)"""


def windows_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.window("ts", CONFIG.window, CONFIG.slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("windowStart"), "n")


def watermarked(spark: SparkSession, d: str) -> DataFrame:
    """(windowStart, n) as a stream with a watermark leaves them: the log in slices by arrival, each a micro-batch, update mode."""
    v = VP(spark, d).select("batchId", F.col("timestamp").cast("timestamp").alias("ts"))
    parts, files = slices(v, WATERMARK_SLICES)
    log, out = fresh(spark, "slices"), fresh(spark, "windows")
    for p in parts:
        if not p.isEmpty():
            p.write.mode("append").parquet(log)
    raw = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", files).parquet(log)
    counts = windows_of(raw.withWatermark("ts", CONFIG.watermark))
    q = counts.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("windowStart").agg(F.max("n").alias("n"))  # the last update of a window has the most


@query("st_1", f"WITH {_WATERMARK_SQL} SELECT windowStart, CAST(count(*) AS BIGINT) AS n FROM kept WHERE ok GROUP BY 1")
def watermark(spark: SparkSession, d: str) -> DataFrame:
    return watermarked(spark, d).select(F.col("windowStart").cast("timestamp_ntz").alias("windowStart"), "n")


@query("st_9", f"WITH {_WATERMARK_SQL} SELECT windowStart, CAST(count(*) AS BIGINT) AS late FROM kept WHERE NOT ok GROUP BY 1")
def refused_as_late(spark: SparkSession, d: str) -> DataFrame:
    """Per window, the pings that the watermark refused: what the whole table has and the stream has not."""
    whole = windows_of(VP(spark, d).filter("timestamp is not null").withColumn("ts", F.col("timestamp").cast("timestamp")))
    both = whole.join(watermarked(spark, d).withColumnRenamed("n", "_in"), "windowStart", "left").withColumn("late", F.col("n") - F.coalesce("_in", F.lit(0)))
    return both.filter("late > 0").select(F.col("windowStart").cast("timestamp_ntz").alias("windowStart"), "late")


def archive(spark: SparkSession, d: str) -> str:
    """The static tables, the timetable and the calendar as a GTFS archive: the path of the file.

    An archive is one file that one machine writes; the static feed is what goes through the driver.
    """
    import csv
    import io
    import zipfile

    def text(df: DataFrame) -> str:
        out = io.StringIO()
        w = csv.writer(out)
        w.writerow(df.columns)
        w.writerows(df.toLocalIterator())
        return out.getvalue()

    points = SHAPES(spark, d).select(F.col("shapeId").alias("shape_id"), F.explode("pts").alias("p")).select(
        "shape_id", F.col("p.lat").alias("shape_pt_lat"), F.col("p.lon").alias("shape_pt_lon"), F.col("p.seq").alias("shape_pt_sequence"), (F.col("p.dist_m") / 1000).alias("shape_dist_traveled")
    )
    trips = TRIPS(spark, d).orderBy("feedRow").select(F.col("tripId").alias("trip_id"), F.col("routeId").alias("route_id"), F.col("serviceId").alias("service_id"), F.col("directionId").alias("direction_id"), F.col("shapeId").alias("shape_id"))
    routes = ROUTES(spark, d).select(F.col("routeId").alias("route_id"), F.col("shortName").alias("route_short_name"), F.col("longName").alias("route_long_name"), F.col("routeType").alias("route_type"), F.col("colorHex").alias("route_color"))
    # a trip's stops in no order, times past 24:00, a first stop without departure, and a row without a sequence
    at = F.col("startSeconds") + F.floor((F.col("endSeconds") - F.col("startSeconds")) * F.col("k") / 9)
    clock = F.format_string("%d:%02d:%02d", F.floor(at / 3600).cast("int"), (F.floor(at / 60) % 60).cast("int"), (at % 60).cast("int"))
    stops = flows.timetable_rows(spark, d).select("*", F.explode(F.shuffle(F.sequence(F.lit(0), F.lit(10)))).alias("k")).select(
        F.col("tripId").alias("trip_id"), clock.alias("arrival_time"), F.when(F.col("k") > 0, clock).otherwise("").alias("departure_time"), F.when(F.col("k") < 10, F.col("k") + 1).otherwise(-5).alias("stop_sequence")
    )
    _, weekly, exceptions = flows.calendars(spark)
    day = lambda c: F.date_format(c, "yyyyMMdd")
    calendar = weekly.select(F.col("serviceId").alias("service_id"), *[F.array_contains("days", k).cast("int").alias(n) for k, n in enumerate(gtfs.DAYS)], day("start").alias("start_date"), day("end").alias("end_date"))
    dates = exceptions.select(F.col("serviceId").alias("service_id"), day("date").alias("date"), F.col("exceptionType").alias("exception_type"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in (("routes", routes), ("trips", trips), ("shapes", points), ("stop_times", stops), ("calendar", calendar), ("calendar_dates", dates)):
            z.writestr(f"{name}.txt", text(df))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh(spark, "gtfs") + "/feed.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    return path.toString()


def loaded(spark: SparkSession, d: str) -> gtfs.Snapshot:
    at = archive(spark, d)
    return gtfs.load(spark, at, at.removesuffix("/feed.zip") + "/staged")


@query(
    "src_4",
    f"""WITH {flows.SCHED_CTE}, {flows.CALENDAR_CTE} SELECT (SELECT CAST(count(*) AS BIGINT) FROM gtfs_routes) AS routes, (SELECT CAST(count(*) AS BIGINT) FROM trips) AS trips,
  (SELECT CAST(count(*) AS BIGINT) FROM shapes) AS shapes, (SELECT round(sum(len) / 1000, 1) FROM shapes) AS kilometres, (SELECT CAST(count(*) AS BIGINT) FROM sched) AS scheduled,
  (SELECT CAST(sum(startSeconds) AS BIGINT) FROM sched) AS starts, (SELECT CAST(sum(endSeconds) AS BIGINT) FROM sched) AS ends, (SELECT CAST(count(*) AS BIGINT) FROM active) AS services""",
)
def archive_scan(spark: SparkSession, d: str) -> DataFrame:
    """The feed as an archive, unpacked to the shared folder and read by header names: stop times to trip bounds, calendars to active services."""
    s = loaded(spark, d)
    on = schedule.active_services(flows.calendars(spark)[0], s.calendar, s.exceptions)
    sums = s.scheduled.agg(F.count("*").alias("scheduled"), F.sum("startSeconds").cast("long").alias("starts"), F.sum("endSeconds").cast("long").alias("ends"))
    lengths = s.lines.agg(F.count("*").alias("shapes"), F.round(F.sum("shapeLengthMetres") / 1000, 1).alias("kilometres"))
    return one_row(s.routes.agg(F.count("*").alias("routes")), s.trips.agg(F.count("*").alias("trips")), lengths, sums, on.agg(F.count("*").alias("services")))


@query("src_7", flows.ORACLES["ag_6"])
def cached_timetable(spark: SparkSession, d: str) -> DataFrame:
    """Scheduled headways of all window records, by the stop times and calendars of a cached snapshot of the archive."""
    cache = gtfs.SnapshotCache(lambda: loaded(spark, d))
    first, s = cache.get(), cache.get()
    assert first is s  # within the refresh time it is loaded once
    on = schedule.active_services(flows.calendars(spark)[0], s.calendar, s.exceptions)
    return flows.headways_of(spark, d, s.scheduled, on)


@query("snk_4", f"""SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (status IN {ALERT_SQL}) AS BIGINT) AS alerts FROM route_headways""")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """One batch to both topics, as folders."""
    a, r = fresh(spark, "alerts"), fresh(spark, "records")
    sinks.fan_out(sinks.folder_sink(a), sinks.folder_sink(r))(RH(spark, d), 0)
    return one_row(spark.read.text(r).agg(F.count("*").alias("records")), spark.read.text(a).agg(F.count("*").alias("alerts")))


@query("st_2", """SELECT unnest([b, b - INTERVAL 30 SECOND]) AS windowStart, deliveryId FROM (SELECT deliveryId, time_bucket(INTERVAL 30 SECOND, "timestamp", TIMESTAMP '1970-01-01') AS b FROM vehicle_positions)""")
def hopping_windows(spark: SparkSession, d: str) -> DataFrame:
    return VP(spark, d).select(F.window(F.col("timestamp").cast("timestamp"), "60 seconds", "30 seconds").alias("w"), "deliveryId").select(F.col("w.start").cast("timestamp_ntz").alias("windowStart"), "deliveryId")


@query("st_10", """SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT vehicleId, "timestamp" FROM vehicle_positions)""")
def without_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The optional removal of repeated (vehicleId, timestamp); off in the flagship, whose windows absorb repeats."""
    return VP(spark, d).dropDuplicates(["vehicleId", "timestamp"]).agg(F.count("*").alias("n"))


@query("st_3", flows.ORACLES["gap_pipeline"])
def streamed_records(spark: SparkSession, d: str) -> DataFrame:
    """The flagship as a stream over the table, drained in update mode: the last emission of every window.

    The table is one micro-batch, so that no row is late.
    """
    path = f"{d}/vehicle_positions.parquet"
    at = path if os.path.isdir(path) else f"{path}*"
    raw = spark.readStream.schema(VP(spark, d).schema).option("maxFilesPerTrigger", 1_000_000).parquet(at)
    rows = spacing.records(raw.withColumn("ts", F.col("timestamp").cast("timestamp")), TRIPS(spark, d), SHAPES(spark, d), ROUTES(spark, d), flows.timetable_rows(spark, d), flows.active(spark))
    out = fresh(spark, "records")
    q = spacing.start(rows, out + "-cp", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), once=True)
    q.awaitTermination()
    got = spark.read.parquet(out)
    keys = ["windowStart", "windowEnd", "headwayGroup"]
    last = got.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in got.columns if c not in (*keys, "batch")]), "batch").alias("r")).select(*keys, "r.*")
    return flows.shown(last)
