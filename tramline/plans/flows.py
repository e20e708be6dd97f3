"""Queries of the aggregations, windows, geometry, schedules, episodes, views and streams, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions import geo, ids, status
from tramline.functions.folds import before
from tramline.operators import episodes, gaps, quality, resolve, schedule, snap, spacing, state
from tramline.plans.registry import Registry
from tramline.plans.transit import _DISORDER, ALERT_SQL, NOW_SQL, POINTS_CTE, RESOLVED_CTE, RH, ROUTES, SHAPES, STATUS_SQL, TRIPS, TRIPS_CTE, VP
from tramline.session import keep, one_row
from tramline.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query

# The calendar of the tables' services (fixed values): weekdays from Monday = 0, and one exchanged day.
_FROM, _TO, _SWAP = dt.date(2026, 6, 27), dt.date(2026, 8, 21), dt.date(2026, 8, 5)
_CALENDAR = [("5", [0, 1, 2, 3, 4]), ("3", [5]), ("4", [6]), ("29", [])]
CALENDAR_CTE = f"""days AS (SELECT CAST(unnest(generate_series(DATE '{_FROM}', DATE '{_TO}', INTERVAL 1 DAY)) AS DATE) AS date),
  weekly AS (SELECT date, CASE WHEN isodow(date) <= 5 THEN '5' WHEN isodow(date) = 6 THEN '3' ELSE '4' END AS serviceId FROM days),
  active AS ((SELECT * FROM weekly UNION SELECT DATE '{_SWAP}', '3') EXCEPT SELECT DATE '{_SWAP}', '5')"""
SCHED_CTE = f"""{TRIPS_CTE.replace("AS rn FROM", "AS rn, feedRow FROM")}, {POINTS_CTE},
  sched AS (SELECT r.shortName || ':' || t.directionId AS headwayGroup, t.tripId, t.serviceId, CAST((t.feedRow * 7919) % 86400 AS INTEGER) AS startSeconds,
      CAST((t.feedRow * 7919) % 86400 + 1800 + t.feedRow % 1200 AS INTEGER) AS endSeconds, s.len AS shapeLengthMetres
    FROM trips t JOIN gtfs_routes r ON r.routeId = t.routeId JOIN shapes s ON s.shapeId = t.shapeId WHERE r.shortName <> '')"""
PER = "111195.08"
PROJECTED_CTE = f"""{RESOLVED_CTE},
  segs AS (SELECT shapeId, seq, lat, lon, m, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(m) OVER w AS m2 FROM points WINDOW w AS (PARTITION BY shapeId ORDER BY seq)),
  flat AS (SELECT r.deliveryId, r.latitude, r.longitude, s.*, (s.lon - r.longitude) * cos(radians(r.latitude)) * {PER} AS ax, (s.lat - r.latitude) * {PER} AS ay,
      (s.lon2 - s.lon) * cos(radians(r.latitude)) * {PER} AS dx, (s.lat2 - s.lat) * {PER} AS dy
    FROM resolved r JOIN segs s ON s.shapeId = r.tripShape WHERE s.lat2 IS NOT NULL AND r.vehicleId IS NOT NULL AND r.latitude IS NOT NULL AND r.longitude IS NOT NULL),
  cut AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM flat),
  best AS (SELECT deliveryId, first(m + t * (m2 - m) ORDER BY d2, seq) AS along, min(d2) AS d2, first(lat + t * (lat2 - lat) ORDER BY d2, seq) AS slat, first(lon + t * (lon2 - lon) ORDER BY d2, seq) AS slon
    FROM (SELECT *, pow(ax + t * dx, 2) + pow(ay + t * dy, 2) AS d2 FROM cut) GROUP BY 1),
  projected AS (SELECT r.*, b.along, sqrt(b.d2) AS cross_, b.slat, b.slon FROM resolved r JOIN best b ON r.deliveryId = b.deliveryId WHERE sqrt(b.d2) <= 150)"""
WINDOWED_CTE = f"""{PROJECTED_CTE},
  buckets AS (SELECT *, time_bucket(INTERVAL 30 SECOND, "timestamp", TIMESTAMP '1970-01-01') AS b FROM projected),
  seen AS (SELECT unnest([b, b - INTERVAL 30 SECOND]) AS windowStart, headwayGroup, routeShortName, routeLongName, tripDirection AS directionId, vehicleId, along AS distanceMetres, "timestamp" AS ts, shapeLengthMetres FROM buckets),
  newest AS (SELECT windowStart, headwayGroup, vehicleId, first(distanceMetres ORDER BY ts DESC, distanceMetres) AS distanceMetres, max(distanceMetres) - min(distanceMetres) AS moved, max(shapeLengthMetres) AS l
    FROM seen GROUP BY ALL),
  placed AS (SELECT *, max(l) OVER (PARTITION BY windowStart, headwayGroup) AS len FROM newest),
  judged AS (SELECT *, (len > 0 AND moved < 25 AND (distanceMetres <= 250 OR distanceMetres >= len - 250)) AS away FROM placed),
  gapped AS (SELECT *, distanceMetres - lag(distanceMetres) OVER w AS gap, lag(vehicleId) OVER w AS behind FROM judged WHERE NOT away
    WINDOW w AS (PARTITION BY windowStart, headwayGroup ORDER BY distanceMetres, vehicleId))"""
NTZ = "timestamp_ntz"


def stamped(spark: SparkSession, d: str) -> DataFrame:
    return VP(spark, d).withColumn("ts", F.col("timestamp").cast("timestamp"))


def projected(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    return spacing.project(stamped(spark, d), TRIPS(spark, d), SHAPES(spark, d), ROUTES(spark, d), lines)


def timetable_rows(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """The tables have no stop times: starts and durations follow from a trip's row in the feed."""
    t = resolve.usable_trips(TRIPS(spark, d), keep_order=True)
    r = ROUTES(spark, d).filter("shortName <> ''").select("routeId", "shortName")
    lines = (resolve.polylines(SHAPES(spark, d)) if lines is None else lines).select("shapeId", "shapeLengthMetres")
    start = (F.col("feedRow") * 7919) % 86400
    return t.join(r, "routeId").join(lines, "shapeId").select(
        F.concat_ws(":", "shortName", F.col("directionId").cast("string")).alias("headwayGroup"), "tripId", "serviceId", start.cast("int").alias("startSeconds"), (start + 1800 + F.col("feedRow") % 1200).cast("int").alias("endSeconds"), "shapeLengthMetres"
    )


def calendars(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dates, weekly calendar, exceptions)."""
    days = [(_FROM + dt.timedelta(k),) for k in range((_TO - _FROM).days + 1)]
    return (
        spark.createDataFrame(days, "date date"),
        spark.createDataFrame([(s, x, _FROM, _TO) for s, x in _CALENDAR], "serviceId string, days array<int>, start date, end date"),
        spark.createDataFrame([("3", _SWAP, 1), ("5", _SWAP, 2)], "serviceId string, date date, exceptionType int"),
    )


def active(spark: SparkSession) -> DataFrame:
    return schedule.active_services(*calendars(spark))


# Aggregations ----------------------------------------------------------------------------------------


@query("ag_1", f"WITH {WINDOWED_CTE} SELECT windowStart, headwayGroup, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT vehicleId) AS BIGINT) AS vehicles, round(max(shapeLengthMetres), 2) AS len FROM seen GROUP BY 1, 2")
def window_collect(spark: SparkSession, d: str) -> DataFrame:
    w = spacing.windowed(projected(spark, d))
    return w.groupBy(F.col("windowStart").cast(NTZ).alias("windowStart"), "headwayGroup").agg(F.count("*").alias("n"), F.count_distinct("vehicleId").alias("vehicles"), F.round(F.max("shapeLengthMetres"), 2).alias("len"))


def newest_seen(spark: SparkSession, d: str) -> DataFrame:
    return gaps.newest(spacing.windowed(projected(spark, d)), ["windowStart", "headwayGroup"], F.col("shapeLengthMetres"))


@query("ag_2", f"WITH {WINDOWED_CTE} SELECT windowStart, headwayGroup, vehicleId, round(distanceMetres, 2) AS at, round(moved, 2) AS moved FROM newest")
def newest_per_vehicle(spark: SparkSession, d: str) -> DataFrame:
    return newest_seen(spark, d).select(F.col("windowStart").cast(NTZ).alias("windowStart"), "headwayGroup", "vehicleId", F.round("distanceMetres", 2).alias("at"), F.round("movedMetres", 2).alias("moved"))


def moving(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("windowStart", "headwayGroup")
    n = newest_seen(spark, d).withColumn("lengthMetres", F.max("lengthMetres").over(w))
    return n.filter(~gaps.is_layover(F.col("movedMetres"), F.col("distanceMetres"), F.col("lengthMetres")))


@query("wn_1", f"WITH {WINDOWED_CTE} SELECT windowStart, headwayGroup, vehicleId, round(gap, 2) AS gap FROM gapped")
def neighbour_gap(spark: SparkSession, d: str) -> DataFrame:
    g = gaps.neighbour_gaps(moving(spark, d), ["windowStart", "headwayGroup"])
    return g.select(F.col("windowStart").cast(NTZ).alias("windowStart"), "headwayGroup", "vehicleId", F.round("gapMetres", 2).alias("gap"))


@query("ag_3", f"""WITH {WINDOWED_CTE} SELECT windowStart, headwayGroup, CAST(count(*) AS INTEGER) AS n, round(min(gap), 2) AS least, round(median(gap), 2) AS middle, round(max(gap), 2) AS most, round(avg(gap), 2) AS mean FROM gapped GROUP BY 1, 2""")
def gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = gaps.gap_statistics(gaps.neighbour_gaps(moving(spark, d), ["windowStart", "headwayGroup"]), ["windowStart", "headwayGroup"])
    r = lambda c, n: F.round(c, 2).alias(n)
    return g.select(F.col("windowStart").cast(NTZ).alias("windowStart"), "headwayGroup", F.col("vehicleCount").alias("n"), r("minGapMetres", "least"), r("medianGapMetres", "middle"), r("maxGapMetres", "most"), r("meanGapMetres", "mean"))


@query("wn_7", f"""WITH {WINDOWED_CTE} SELECT windowStart, headwayGroup, first(behind || '>' || vehicleId ORDER BY round(gap, 6), distanceMetres, vehicleId) AS pair FROM gapped WHERE gap IS NOT NULL GROUP BY 1, 2""")
def worst_pair(spark: SparkSession, d: str) -> DataFrame:
    g = gaps.gaps(spacing.windowed(projected(spark, d)), ["windowStart", "headwayGroup"], F.col("shapeLengthMetres")).filter(F.size("gapsMetres") > 0)
    return g.select(F.col("windowStart").cast(NTZ).alias("windowStart"), "headwayGroup", F.array_join("worstPairVehicles", ">").alias("pair"))


@query("ag_4", """WITH s AS (SELECT l_orderkey, l_linenumber AS q, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem)
  SELECT l_orderkey, first(t ORDER BY q, t) AS starts, first(t ORDER BY q DESC, t) AS ends FROM s GROUP BY 1""")
def trip_bounds(spark: SparkSession, d: str) -> DataFrame:
    from tramline.sources.gtfs import trip_bounds as bounds

    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tripId"), F.col("l_linenumber").alias("sequence"), ids.seconds("l_shipdate").alias("second"))
    return bounds(s).select(F.col("tripId").alias("l_orderkey"), F.col("startSeconds").alias("starts"), F.col("endSeconds").alias("ends"))


@query("ag_5", f"WITH {POINTS_CTE} SELECT shapeId, CAST(n AS INTEGER) AS n, round(len, 2) AS len FROM shapes")
def shape_assembly(spark: SparkSession, d: str) -> DataFrame:
    return resolve.polylines(SHAPES(spark, d)).select("shapeId", F.col("pointCount").alias("n"), F.round("shapeLengthMetres", 2).alias("len"))


@query("ag_7", f"WITH {CALENDAR_CTE} SELECT CAST(date AS VARCHAR) AS date, serviceId FROM active")
def services(spark: SparkSession, d: str) -> DataFrame:
    return active(spark).withColumn("date", F.col("date").cast("string"))


@query("ag_8", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date, (CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30') AS covered FROM orders")
def calendar_coverage(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    weekly = spark.createDataFrame([("a", dt.date(1995, 1, 1), dt.date(1995, 12, 31)), ("b", dt.date(1995, 10, 1), dt.date(1996, 6, 30))], "serviceId string, start date, end date")
    return schedule.covered(dates, weekly).withColumn("date", F.col("date").cast("string"))


MOMENTS_CTE = """moments AS (SELECT DISTINCT headwayGroup, CAST(x AS DATE) AS date, CAST(hour(x) * 3600 + minute(x) * 60 + second(x) AS INTEGER) AS second
    FROM (SELECT headwayGroup, (windowEnd AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS x FROM route_headways))"""


def _near(moments: str = "moments") -> str:
    return f"""near AS (SELECT m.headwayGroup, m.date, m.second, s.startSeconds, s.startSeconds - lag(s.startSeconds) OVER w AS gap,
      CASE WHEN s.shapeLengthMetres > 0 THEN s.shapeLengthMetres / greatest(1, s.endSeconds - s.startSeconds) END AS pace
    FROM {moments} m JOIN sched s ON s.headwayGroup = m.headwayGroup AND abs(s.startSeconds - m.second) <= 2700
    JOIN active a ON a.date = m.date AND a.serviceId = s.serviceId WINDOW w AS (PARTITION BY m.headwayGroup, m.date, m.second ORDER BY s.startSeconds)),
  found AS (SELECT headwayGroup, date, second, CAST(count(*) AS INTEGER) AS trips,
      list_sort(list(gap) FILTER (gap > 0))[CAST(floor(count(*) FILTER (gap > 0) / 2) AS INTEGER) + 1] AS headway,
      list_sort(list(pace) FILTER (pace IS NOT NULL))[CAST(floor(count(pace) / 2) AS INTEGER) + 1] AS speed
    FROM near GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(*) FILTER (gap > 0) > 0 AND count(pace) > 0)"""


@query("ag_6", f"WITH {SCHED_CTE}, {CALENDAR_CTE}, {MOMENTS_CTE}, {_near()} SELECT headwayGroup, CAST(date AS VARCHAR) AS date, second, trips, CAST(headway AS INTEGER) AS headway, round(speed, 4) AS speed FROM found")
def scheduled_headway(spark: SparkSession, d: str) -> DataFrame:
    return headways_of(spark, d, timetable_rows(spark, d), active(spark))


def headways_of(spark: SparkSession, d: str, trips: DataFrame, on: DataFrame) -> DataFrame:
    date, second = spacing.moment("windowEnd")
    m = RH(spark, d).select("headwayGroup", date.alias("date"), second.alias("second")).distinct()
    s = schedule.scheduled_headways(m, trips, on)
    return s.select("headwayGroup", F.col("date").cast("string").alias("date"), "second", F.col("tripsConsidered").alias("trips"), F.col("scheduledHeadwaySeconds").alias("headway"), F.round("averageSpeedMps", 4).alias("speed"))


@query("jn_7", f"WITH {SCHED_CTE}, {CALENDAR_CTE}, {MOMENTS_CTE}, {_near()} SELECT headwayGroup, CAST(date AS VARCHAR) AS date, second, CAST(headway AS INTEGER) AS headway, round(speed, 4) AS speed FROM found")
def schedule_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The same lookup by arrays, as streams do it: one timetable per group, the day's services as an array."""
    date, second = spacing.moment("windowEnd")
    m = RH(spark, d).select("headwayGroup", date.alias("date"), second.alias("second")).distinct()
    on = active(spark).groupBy("date").agg(F.collect_set("serviceId").alias("services"))
    x = m.join(schedule.timetable(timetable_rows(spark, d)), "headwayGroup").join(F.broadcast(on), "date")
    got = x.withColumn("s", schedule.scheduled_from_array(F.col("timetable"), F.col("second"), F.col("services"))).filter("s is not null")
    return got.select("headwayGroup", F.col("date").cast("string").alias("date"), "second", F.col("s.scheduledHeadwaySeconds").alias("headway"), F.round("s.averageSpeedMps", 4).alias("speed"))


@query("wn_2", f"WITH {SCHED_CTE}, g AS (SELECT headwayGroup, startSeconds - lag(startSeconds) OVER (PARTITION BY headwayGroup ORDER BY startSeconds) AS gap FROM sched) SELECT headwayGroup, CAST(count(*) AS BIGINT) AS n, CAST(min(gap) AS INTEGER) AS least, CAST(max(gap) AS INTEGER) AS most FROM g WHERE gap > 0 GROUP BY 1")
def departure_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("headwayGroup").orderBy("startSeconds")
    g = timetable_rows(spark, d).withColumn("gap", F.col("startSeconds") - F.lag("startSeconds").over(w)).filter("gap > 0")
    return g.groupBy("headwayGroup").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))


@query("flt_13", """SELECT l_orderkey, starts, ends FROM (SELECT l_orderkey, first(t ORDER BY q, t) AS starts, first(t ORDER BY q DESC, t) AS ends
  FROM (SELECT l_orderkey, l_linenumber AS q, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem) GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey WHERE ends > starts AND o_orderstatus <> ''""")
def sane_trips(spark: SparkSession, d: str) -> DataFrame:
    return trip_bounds(spark, d).filter("ends > starts").join(table(spark, d, "orders").filter("o_orderstatus <> ''"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("ag_9", """SELECT vehicle, latest FROM (SELECT upper(trim(vehicleId)) AS vehicle, first(deliveryId ORDER BY "timestamp" DESC, deliveryId DESC) AS latest FROM vehicle_positions GROUP BY 1)""")
def latest_per_vehicle(spark: SparkSession, d: str) -> DataFrame:
    v = VP(spark, d).select(ids.normal_id("vehicleId").alias("vehicle"), "timestamp", "deliveryId")
    return state.newest(v, "vehicle", "timestamp", "deliveryId").select("vehicle", F.col("deliveryId").alias("latest"))


LATEST_CTE = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY headwayGroup ORDER BY windowEnd DESC, emittedAt DESC, recordId DESC) AS rn FROM route_headways WHERE headwayGroup IS NOT NULL AND windowEnd IS NOT NULL) WHERE rn = 1)"


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    return state.newest(RH(spark, d).filter("windowEnd is not null"), "headwayGroup", "windowEnd", "emittedAt", "recordId")


@query("ag_10", f"WITH {LATEST_CTE} SELECT headwayGroup, recordId, windowEnd, status FROM latest")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return latest_records(spark, d).select("headwayGroup", "recordId", "windowEnd", "status")


OUTCOME_CTE = """o AS (SELECT deliveryId, upper(trim(vehicleId)) AS vehicle, "timestamp" AS t, receivedAt, max("timestamp") OVER (PARTITION BY upper(trim(vehicleId)) ORDER BY receivedAt, deliveryId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM vehicle_positions),
  outcomes AS (SELECT deliveryId, CASE WHEN top IS NULL THEN 'NEW' WHEN t > top THEN 'UPDATED' ELSE 'STALE' END AS outcome FROM o)"""


def ping_outcomes(spark: SparkSession, d: str) -> DataFrame:
    v = VP(spark, d).select(ids.normal_id("vehicleId").alias("vehicle"), "timestamp", "receivedAt", "deliveryId")
    return state.outcomes(v, "vehicle", "timestamp", ["receivedAt", "deliveryId"]).select("deliveryId", "outcome")


@query("wn_6", f"WITH {OUTCOME_CTE} SELECT deliveryId, outcome FROM outcomes")
def store_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ping_outcomes(spark, d)


@query("ag_11", f"WITH {OUTCOME_CTE} SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM outcomes GROUP BY 1")
def outcome_tally(spark: SparkSession, d: str) -> DataFrame:
    return ping_outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("ag_12", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT routeId) AS BIGINT) AS routes, CAST(count(DISTINCT upper(trim(vehicleId))) AS BIGINT) AS vehicles FROM vehicle_positions")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return VP(spark, d).agg(F.count("*").alias("n"), F.count_distinct("routeId").alias("routes"), F.count_distinct(ids.normal_id("vehicleId")).alias("vehicles"))


@query("ag_13", "SELECT routeId, CAST(count(DISTINCT upper(trim(vehicleId))) AS BIGINT) AS n FROM vehicle_positions GROUP BY 1 ORDER BY n DESC, routeId LIMIT 5")
def busiest_routes(spark: SparkSession, d: str) -> DataFrame:
    return VP(spark, d).groupBy("routeId").agg(F.count_distinct(ids.normal_id("vehicleId")).alias("n")).orderBy(F.desc("n"), "routeId").limit(5)


def covered_pings(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(VP(spark, d), TRIPS(spark, d), SHAPES(spark, d), ROUTES(spark, d))


@query("ag_14", f"WITH {RESOLVED_CTE} SELECT CAST(tripDirection AS INTEGER) AS direction, CAST(count(*) AS BIGINT) AS n FROM resolved GROUP BY 1")
def direction_split(spark: SparkSession, d: str) -> DataFrame:
    return covered_pings(spark, d).filter("outcome = 'resolved'").groupBy(F.col("tripDirection").alias("direction")).agg(F.count("*").alias("n"))


@query("ag_15", f"WITH {RESOLVED_CTE} SELECT CAST(count(*) AS BIGINT) AS total, (SELECT CAST(count(*) AS BIGINT) FROM resolved) AS resolved, round((SELECT count(*) FROM resolved) * 100.0 / count(*), 6) AS percent FROM vehicle_positions")
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    return quality.percentages(covered_pings(spark, d)).withColumn("percent", F.round("percent", 6))


PAIRS_CTE = """l AS (SELECT *, lag(projectionId) OVER w AS beforeId, lag(shapeId) OVER w AS s0, lag(distanceAlongRouteMetres) OVER w AS d0, lag("timestamp") OVER w AS t0 FROM shape_projections WINDOW w AS (PARTITION BY vehicleId ORDER BY "timestamp", projectionId)),
  pairs AS (SELECT projectionId, beforeId, vehicleId, shapeId, deliveryId, (epoch_us("timestamp") - epoch_us(t0)) / 1e6 AS seconds, distanceAlongRouteMetres - d0 AS delta FROM l WHERE s0 = shapeId AND (epoch_us("timestamp") - epoch_us(t0)) / 1e6 >= 5),
  speeds AS (SELECT p.*, delta / seconds AS implied, v.speedMetersPerSecond AS reported FROM pairs p JOIN vehicle_positions v ON v.deliveryId = p.deliveryId)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return quality.moving_pairs(table(spark, d, "shape_projections"), ["vehicleId"])


def speeds(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).join(VP(spark, d).select("deliveryId", F.col("speedMetersPerSecond").alias("reported")), "deliveryId")


@query("jn_8", f"WITH {PAIRS_CTE} SELECT projectionId, beforeId, round(delta, 3) AS delta, round(seconds, 3) AS seconds FROM pairs")
def two_samples(spark: SparkSession, d: str) -> DataFrame:
    """Second sample to first, by (vehicle, shape), as a join of the two."""
    return pairs(spark, d).select("projectionId", "beforeId", F.round("deltaMetres", 3).alias("delta"), F.round("seconds", 3).alias("seconds"))


@query("wn_8", f"WITH {PAIRS_CTE} SELECT projectionId, round(delta / seconds, 6) AS speed FROM pairs")
def implied_speed(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("projectionId", F.round("impliedMps", 6).alias("speed"))


@query("flt_14", f"WITH {PAIRS_CTE} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (delta < -20) AS BIGINT) AS backward, CAST(count(*) FILTER (abs(delta / seconds) > 35) AS BIGINT) AS absurd FROM pairs")
def pair_quality(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).agg(F.count("*").alias("n"), F.count_if("backward").alias("backward"), F.count_if("absurd").alias("absurd"))


@query("ag_16", "SELECT status, quantile_disc(minGapMetres, 0.5) AS p50, quantile_disc(minGapMetres, 0.9) AS p90, quantile_disc(minGapMetres, 0.99) AS p99, max(minGapMetres) AS most FROM route_headways GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    r = RH(spark, d)
    ranks = quality.nearest_ranks(r, ["status"], "minGapMetres", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    most = r.groupBy("status").agg(F.max("minGapMetres").alias("most")).withColumnRenamed("status", "_s")
    return most.join(ranks, F.col("status").eqNullSafe(F.col("_s")), "left").select(F.col("_s").alias("status"), "p50", "p90", "p99", "most")


@query("ag_17", "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY 1")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(quality.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query("ag_18", f"""WITH {PAIRS_CTE}, e AS (SELECT *, abs(implied - reported) AS err FROM speeds WHERE reported IS NOT NULL AND NOT isnan(reported)),
  a AS (SELECT CAST(count(*) AS BIGINT) AS pairs, avg(implied) AS mi, avg(reported) AS mr, quantile_disc(err, 0.5) AS p50, quantile_disc(err, 0.9) AS p90, max(err) AS worst, coalesce(corr(implied, reported), 0) AS r FROM e)
  SELECT pairs, round(mi, 4) AS mean_implied, round(mr, 4) AS mean_reported, round(p50, 4) AS p50, round(p90, 4) AS p90, round(worst, 4) AS worst, round(r, 4) AS r,
    CASE WHEN pairs < 5 THEN 'too few' WHEN r > 0.7 AND abs(mi - mr) < 3 THEN 'agree' ELSE 'disagree' END AS verdict FROM a""")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = quality.accuracy(speeds(spark, d), "reported")
    return a.withColumns({c: F.round(c, 4) for c in ("mean_implied", "mean_reported", "p50", "p90", "worst", "r")})


@query("ag_20", "SELECT max(windowEnd) AS newest FROM route_headways")
def newest_window(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).agg(F.max("windowEnd").alias("newest"))


# Geometry --------------------------------------------------------------------------------------------

_PROJ = ("distanceAlongRouteMetres", "along"), ("crossTrackMetres", "cross_track"), ("snappedLatitude", "slat"), ("snappedLongitude", "slon")


@query("pr_1", f"WITH {PROJECTED_CTE} SELECT deliveryId, round(along, 2) AS along, round(cross_, 3) AS cross_track, round(slat, 7) AS slat, round(slon, 7) AS slon FROM projected")
def nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("deliveryId", *[F.round(c, n).alias(a) for (c, a), n in zip(_PROJ, (2, 3, 7, 7), strict=True)])


# Positions q(id, shapeId, y, x, hint) against the segments sg(shapeId, k, lat, lon, m, lat2, lon2, m2), held to those that meet the hint.
_SEGS = "sg AS (SELECT * FROM (SELECT shapeId, row_number() OVER w - 1 AS k, lat, lon, m, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(m) OVER w AS m2 FROM {points} WINDOW w AS (PARTITION BY shapeId ORDER BY seq)) WHERE lat2 IS NOT NULL)"
_HELD = f"""f AS (SELECT q.id, q.hint, s.*, min(s.m) OVER (PARTITION BY q.id) AS m0, (s.lon - q.x) * cos(radians(q.y)) * {PER} AS ax, (s.lat - q.y) * {PER} AS ay, (s.lon2 - s.lon) * cos(radians(q.y)) * {PER} AS dx, (s.lat2 - s.lat) * {PER} AS dy
    FROM q JOIN sg s ON s.shapeId = q.shapeId),
  g AS (SELECT *, CASE WHEN hint + {{w}} < m0 THEN k = 0 ELSE coalesce(m2 >= hint - {{w}} AND m <= hint + {{w}}, false) END AS meets FROM f),
  h AS (SELECT *, bool_or(meets) OVER (PARTITION BY id) AS anyone FROM g),
  c AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM h WHERE meets OR NOT anyone),
  e AS (SELECT id, first(along ORDER BY round(d2, 6), k) AS along, sqrt(first(d2 ORDER BY round(d2, 6), k)) AS cross_ FROM (SELECT id, k, m + t * (m2 - m) AS along, pow(ax + t * dx, 2) + pow(ay + t * dy, 2) AS d2 FROM c) GROUP BY 1)"""
_OWN = """q AS (SELECT projectionId AS id, trim(shapeId) AS shapeId, snappedLatitude AS y, snappedLongitude AS x, {hint} AS hint FROM shape_projections)"""
_DOUBLED = "doubled AS (SELECT shapeId, seq * 2 + j AS seq, lat, lon, m FROM points, (VALUES (0), (1)) AS twice(j) WHERE j = 0 OR seq % 10 = 0)"


def own_places(spark: SparkSession, d: str, *more) -> DataFrame:
    p = table(spark, d, "shape_projections")
    return p.select("projectionId", ids.bare("shapeId").alias("shapeId"), F.col("snappedLatitude").alias("y"), F.col("snappedLongitude").alias("x"), *more)


@query("pr_2", f"WITH {POINTS_CTE}, {_DOUBLED}, {_SEGS.format(points='doubled')}, {_OWN.format(hint='NULL::DOUBLE')}, {_HELD.format(w=0)} SELECT id AS projectionId, round(along, 2) AS along, round(cross_, 2) AS cross_track FROM e")
def zero_length(spark: SparkSession, d: str) -> DataFrame:
    """Every shape with every tenth point twice, so that it has segments without length."""
    points = resolve.shape_points(SHAPES(spark, d).select(ids.bare("shapeId").alias("shapeId"), F.explode("pts").alias("p")).select("shapeId", "p.*"))
    twice = points.withColumn("j", F.explode(F.when(F.col("seq") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    lines = keep(resolve.assemble(twice.withColumn("seq", F.col("seq") * 2 + F.col("j"))))
    n = snap.snap(own_places(spark, d), lines, "shapeId", "y", "x").filter("segmentIndex is not null")
    return n.select("projectionId", F.round("distanceAlongRouteMetres", 2).alias("along"), F.round("crossTrackMetres", 2).alias("cross_track"))


@query("pr_3", f"WITH {POINTS_CTE}, {_SEGS.format(points='points')}, {_OWN.format(hint='distanceAlongRouteMetres + projectionId % 5 * 1000 - 2000')}, {_HELD.format(w=400)} SELECT id AS projectionId, round(along, 2) AS along FROM e")
def hinted(spark: SparkSession, d: str) -> DataFrame:
    """Projections again, hinted with where they were, or up to two kilometres off."""
    p = own_places(spark, d, (F.col("distanceAlongRouteMetres") + F.col("projectionId") % 5 * 1000 - 2000).alias("hint"))
    n = snap.snap(p, keep(resolve.polylines(SHAPES(spark, d))), "shapeId", "y", "x", hint="hint", window=400.0)
    return n.filter("segmentIndex is not null").select("projectionId", F.round("distanceAlongRouteMetres", 2).alias("along"))


@query("pr_4", f"""WITH {POINTS_CTE}, {_SEGS.format(points='points')}, {_OWN.format(hint='lag(distanceAlongRouteMetres) OVER (PARTITION BY vehicleId, trim(shapeId) ORDER BY "timestamp", projectionId)')}, {_HELD.format(w=3000)}
  SELECT id AS projectionId, round(along, 2) AS along FROM e""")
def hint_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """Projections again, each hinted with the one before of the same vehicle on the same shape."""
    p = own_places(spark, d, "vehicleId", "timestamp", "distanceAlongRouteMetres")
    h = before(p, ["vehicleId", "shapeId"], ["timestamp", "projectionId"], lag_of={"hint": F.col("distanceAlongRouteMetres")}).select("projectionId", "shapeId", "y", "x", "hint")
    n = snap.snap(h, keep(resolve.polylines(SHAPES(spark, d))), "shapeId", "y", "x", hint="hint")
    return n.filter("segmentIndex is not null").select("projectionId", F.round("distanceAlongRouteMetres", 2).alias("along"))


_VERTEX = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shapeId ORDER BY seq) - 1 AS n FROM points) WHERE n % 40 = 0), q AS (SELECT shapeId || '#' || n AS id, shapeId, lat AS y, lon AS x, {hint} AS hint FROM v)"
_ONE = f"WITH {POINTS_CTE}, {{segs}}, {{vertex}}, {{held}} SELECT * FROM e"


def _vertex_sql() -> str:
    of = lambda hint: _ONE.format(segs=_SEGS.format(points="points"), vertex=_VERTEX.format(hint=hint), held=_HELD.format(w=400))
    return f"""WITH {POINTS_CTE}, free AS ({of('NULL::DOUBLE')}), held AS ({of('m')}), {_VERTEX.format(hint='m')},
  j AS (SELECT q.shapeId, abs(free.along - q.hint) AS err, free.cross_ AS cross_, abs(held.along - q.hint) AS held_err FROM q JOIN free ON free.id = q.id JOIN held ON held.id = q.id)
  SELECT CAST(count(*) AS BIGINT) AS checked, round(max(err), 3) AS worst_along, round(max(cross_), 3) AS worst_cross, CAST(count(*) FILTER (err > 50) AS BIGINT) AS ambiguous, CAST(count(DISTINCT CASE WHEN err > 50 THEN shapeId END) AS BIGINT) AS shapes,
    CAST(count(*) FILTER (err > 50 AND held_err > 50) AS BIGINT) AS hinted_failures FROM j"""


@query("ag_19", _vertex_sql())
def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    s = SHAPES(spark, d)
    points = resolve.shape_points(s.select(ids.bare("shapeId").alias("shapeId"), F.explode("pts").alias("p")).select("shapeId", "p.*"))
    a = quality.self_consistency(points, keep(resolve.polylines(s)))
    return a.withColumns({c: F.round(c, 3) for c in ("worst_along", "worst_cross")})


@query("pr_5", f"WITH {POINTS_CTE} SELECT CAST(count(*) AS BIGINT) AS shapes, CAST(sum(n) AS BIGINT) AS points, round(max(len), 2) AS longest FROM shapes")
def shape_accessors(spark: SparkSession, d: str) -> DataFrame:
    return resolve.polylines(SHAPES(spark, d)).agg(F.count("*").alias("shapes"), F.sum("pointCount").alias("points"), F.round(F.max("shapeLengthMetres"), 2).alias("longest"))


@query("wn_4", f"WITH {POINTS_CTE} SELECT shapeId, seq, round(sum(step) OVER (PARTITION BY shapeId ORDER BY seq), 3) AS way FROM way_pts")
def cumulative_distance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("shapeId").orderBy("seq")
    p = SHAPES(spark, d).select(ids.bare("shapeId").alias("shapeId"), F.explode("pts").alias("p")).select("shapeId", "p.*")
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return p.withColumn("s", step).select("shapeId", "seq", F.round(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("way"))


@query("wn_5", """WITH p AS (SELECT shapeId, unnest(pts) AS p FROM gtfs_shapes), l AS (SELECT trim(shapeId) AS shapeId, p.seq AS seq, p.dist_m AS d, lag(p.dist_m) OVER (PARTITION BY shapeId ORDER BY p.seq) AS pd, lag(p.seq) OVER (PARTITION BY shapeId ORDER BY p.seq) AS ps FROM p)
  SELECT shapeId, CAST(count(*) FILTER (seq <= ps) AS BIGINT) AS out_of_sequence, bool_or(d IS NULL OR isnan(d) OR coalesce(d < pd, false)) AS unusable FROM l GROUP BY 1""")
def monotonicity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("shapeId").orderBy("seq")
    p = SHAPES(spark, d).select(ids.bare("shapeId").alias("shapeId"), F.explode("pts").alias("p")).select("shapeId", "p.*")
    odd = F.col("dist_m").isNull() | F.isnan("dist_m") | F.coalesce(F.col("dist_m") < F.lag("dist_m").over(w), F.lit(False))
    return p.withColumns({"odd": odd, "back": F.col("seq") <= F.lag("seq").over(w)}).groupBy("shapeId").agg(F.count_if("back").alias("out_of_sequence"), F.bool_or("odd").alias("unusable"))


@query("wn_3", f"""WITH {PROJECTED_CTE}, n AS (SELECT headwayGroup, vehicleId, first(along ORDER BY "timestamp" DESC, along) AS place FROM projected GROUP BY 1, 2),
  g AS (SELECT headwayGroup, vehicleId, place - lag(place) OVER (PARTITION BY headwayGroup ORDER BY place, vehicleId) AS gap FROM n)
  SELECT headwayGroup, vehicleId, round(gap, 2) AS gap FROM g WHERE gap IS NOT NULL ORDER BY round(gap, 2), headwayGroup, vehicleId LIMIT 8""")
def gap_preview(spark: SparkSession, d: str) -> DataFrame:
    """The tightest pairs of all groups, by every vehicle's newest place."""
    p = projected(spark, d).select("headwayGroup", "vehicleId", F.col("distanceAlongRouteMetres").alias("distanceMetres"), "ts")
    g = gaps.neighbour_gaps(gaps.newest(p, ["headwayGroup"]), ["headwayGroup"]).filter("gapMetres is not null")
    return g.select("headwayGroup", "vehicleId", F.round("gapMetres", 2).alias("gap")).orderBy("gap", "headwayGroup", "vehicleId").limit(8)


@query("udf_1", f"WITH {PROJECTED_CTE} SELECT deliveryId, headwayGroup, routeShortName, CAST(tripDirection AS INTEGER) AS directionId, round(along, 2) AS along, tripShape AS shape FROM projected")
def project_ping(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("deliveryId", "headwayGroup", "routeShortName", F.col("tripDirection").alias("directionId"), F.round("distanceAlongRouteMetres", 2).alias("along"), F.col("tripShape").alias("shape"))


_RECORDS = f"""WITH {WINDOWED_CTE}, {SCHED_CTE.replace(TRIPS_CTE.replace("AS rn FROM", "AS rn, feedRow FROM") + ", " + POINTS_CTE + ",", "").strip()
    .replace("FROM trips t", "FROM (SELECT * FROM (SELECT trim(tripId) AS tripId, routeId, serviceId, directionId, trim(shapeId) AS shapeId, feedRow, row_number() OVER (PARTITION BY trim(tripId) ORDER BY feedRow DESC) AS rn FROM gtfs_trips WHERE trim(tripId) <> '' AND directionId IN (0, 1) AND trim(shapeId) <> '') WHERE rn = 1) t")}, {CALENDAR_CTE},
  stats AS (SELECT windowStart, headwayGroup, CAST(count(*) FILTER (NOT away) AS INTEGER) AS n, list(vehicleId ORDER BY distanceMetres, vehicleId) FILTER (NOT away) AS ordered, list(vehicleId ORDER BY vehicleId) FILTER (away) AS away_ FROM judged GROUP BY 1, 2),
  g AS (SELECT windowStart, headwayGroup, min(gap) AS least, median(gap) AS middle, max(gap) AS most, avg(gap) AS mean FROM gapped GROUP BY 1, 2),
  local AS (SELECT *, ((windowStart + INTERVAL 60 SECOND) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS x FROM stats),
  ats AS (SELECT *, CAST(x AS DATE) AS date, CAST(hour(x) * 3600 + minute(x) * 60 + second(x) AS INTEGER) AS second FROM local),
  moments AS (SELECT DISTINCT headwayGroup, date, second FROM ats), {_near()},
  rec AS (SELECT ats.windowStart, ats.headwayGroup, ats.n, ats.ordered, ats.away_, g.least, g.middle, g.most, g.mean, f.headway, f.speed, CASE WHEN f.headway * f.speed > 0 THEN g.least / (f.headway * f.speed) END AS ratio
    FROM ats LEFT JOIN g ON g.windowStart = ats.windowStart AND g.headwayGroup = ats.headwayGroup LEFT JOIN found f ON f.headwayGroup = ats.headwayGroup AND f.date = ats.date AND f.second = ats.second)
  SELECT windowStart, headwayGroup, n, array_to_string(coalesce(ordered, []), ',') AS vehicles, array_to_string(coalesce(away_, []), ',') AS layover, round(least, 2) AS least, round(middle, 2) AS middle, round(most, 2) AS most, round(mean, 2) AS mean,
    CAST(headway AS INTEGER) AS headway, round(ratio, 4) AS ratio, CASE WHEN n < 2 AND len(away_) > 0 THEN 'LAYOVER' ELSE {STATUS_SQL.format(r='ratio')} END AS status FROM rec"""


def records(spark: SparkSession, d: str) -> DataFrame:
    lines = keep(resolve.polylines(SHAPES(spark, d)))
    return spacing.batch_records(projected(spark, d, lines), timetable_rows(spark, d, lines), active(spark))


def shown(r: DataFrame) -> DataFrame:
    n = lambda c, k, a: F.round(c, k).alias(a)
    return r.select(
        F.col("windowStart").cast(NTZ).alias("windowStart"), "headwayGroup", F.col("vehicleCount").alias("n"), F.array_join("orderedVehicles", ",").alias("vehicles"), F.array_join("layoverVehicles", ",").alias("layover"),
        n("minGapMetres", 2, "least"), n("medianGapMetres", 2, "middle"), n("maxGapMetres", 2, "most"), n("meanGapMetres", 2, "mean"), F.col("scheduledHeadwaySeconds").alias("headway"), n("headwayRatio", 4, "ratio"), "status",
    )


@query("udf_2", _RECORDS)
def window_records(spark: SparkSession, d: str) -> DataFrame:
    return shown(records(spark, d))


@query("gap_pipeline", f"SELECT * FROM ({_RECORDS}) WHERE n >= 2")
def gap_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: pings to classified window records of two vehicles or more."""
    return shown(records(spark, d).filter("vehicleCount >= 2"))


# Episodes --------------------------------------------------------------------------------------------

EPISODES_CTE = f"""arr AS (SELECT *, max(windowEnd) OVER (PARTITION BY headwayGroup ORDER BY emittedAt, recordId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM route_headways WHERE headwayGroup IS NOT NULL AND windowEnd IS NOT NULL),
  acc AS (SELECT *, coalesce(status IN {ALERT_SQL}, false) AS alert FROM arr WHERE top IS NULL OR windowEnd >= top),
  b AS (SELECT *, coalesce(lag(alert) OVER (PARTITION BY headwayGroup ORDER BY emittedAt, recordId), false) AS was FROM acc),
  seg AS (SELECT *, sum(CASE WHEN alert AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY headwayGroup ORDER BY emittedAt, recordId ROWS UNBOUNDED PRECEDING) AS ep,
    CASE WHEN status LIKE 'SEVERE%' THEN 2 ELSE 1 END AS sev FROM b),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY headwayGroup, ep ORDER BY sev DESC, abs(headwayRatio - 1) DESC, emittedAt, recordId) AS bad, row_number() OVER (PARTITION BY headwayGroup, ep ORDER BY emittedAt DESC, recordId DESC) AS last_ FROM seg WHERE alert),
  eps AS (SELECT headwayGroup, ep, first(windowEnd ORDER BY emittedAt, recordId) AS startedAt, max(windowEnd) AS lastSeenAt, CAST(count(*) AS BIGINT) AS windowsObserved, max(CASE WHEN last_ = 1 THEN status END) AS status,
    max(CASE WHEN bad = 1 THEN status END) AS worstStatus, max(CASE WHEN bad = 1 THEN headwayRatio END) AS worstRatio FROM ranked GROUP BY 1, 2),
  ends AS (SELECT headwayGroup, ep, windowEnd AS endedAt FROM seg WHERE NOT alert AND was),
  full_ AS (SELECT e.headwayGroup || '@' || CAST(epoch_ms(startedAt) AS VARCHAR) AS episodeId, e.headwayGroup, startedAt, lastSeenAt, windowsObserved, status, worstStatus, worstRatio,
    coalesce(x.endedAt, CASE WHEN lastSeenAt < {NOW_SQL} - INTERVAL 3 MINUTE THEN lastSeenAt END) AS endedAt FROM eps e LEFT JOIN ends x ON x.headwayGroup = e.headwayGroup AND x.ep = e.ep)"""
_EP = ["episodeId", "headwayGroup", "startedAt", "lastSeenAt", "windowsObserved", "status", "worstStatus", "worstRatio", "endedAt"]


def all_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes.episodes(RH(spark, d), latest_of(VP(spark, d), "receivedAt"))


@query("wn_9", f"WITH {EPISODES_CTE} SELECT {', '.join(_EP)} FROM full_")
def episode_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return all_episodes(spark, d).select(*_EP)


@query("st_5", f"WITH {EPISODES_CTE} SELECT recordId FROM acc")
def accepted_records(spark: SparkSession, d: str) -> DataFrame:
    return episodes.accepted(RH(spark, d)).select("recordId")


_CHANGES = f"""WITH {EPISODES_CTE},
  firsts AS (SELECT *, row_number() OVER (PARTITION BY headwayGroup, ep, sev ORDER BY emittedAt, recordId) = 1 AS first_ FROM seg WHERE alert),
  so_far AS (SELECT *, max(struct_pack(a := sev, b := coalesce(abs(headwayRatio - 1), CASE WHEN first_ THEN 'Infinity'::DOUBLE ELSE -1 END), c := -epoch_us(emittedAt), d := -recordId, s := status))
      OVER (PARTITION BY headwayGroup, ep ORDER BY emittedAt, recordId ROWS UNBOUNDED PRECEDING) AS worst FROM firsts),
  told AS (SELECT recordId, worst.s AS now_, lag(worst.s) OVER (PARTITION BY headwayGroup, ep ORDER BY emittedAt, recordId) AS before_ FROM so_far)
  SELECT seg.recordId, headwayGroup, windowEnd, CASE WHEN alert AND NOT was THEN 'OPENED' WHEN alert AND now_ <> before_ THEN 'ESCALATED' WHEN alert THEN 'CONTINUED' WHEN was THEN 'CLEARED' ELSE 'NONE' END AS change
  FROM seg LEFT JOIN told ON told.recordId = seg.recordId"""


@query("st_4", _CHANGES)
def episode_changes(spark: SparkSession, d: str) -> DataFrame:
    """What every accepted record did to its group's episode; tests hold it against the stream's fold."""
    return episodes.changes(RH(spark, d))


@query("st_8", f"WITH {EPISODES_CTE} SELECT episodeId, endedAt FROM full_ WHERE endedAt = lastSeenAt")
def silence_sweep(spark: SparkSession, d: str) -> DataFrame:
    return all_episodes(spark, d).filter("endedAt = lastSeenAt").select("episodeId", "endedAt")


# Views -----------------------------------------------------------------------------------------------


def latest_of(rows: DataFrame, column: str):
    """The newest time of a column, as a literal."""
    return F.lit(rows.agg(F.max(column)).first()[0]).cast(NTZ)


def live_routes(spark: SparkSession, d: str) -> DataFrame:
    r = latest_records(spark, d)
    return state.live(r, "windowEnd", latest_of(RH(spark, d), "windowEnd"), CONFIG.route_ttl).withColumn("disorder", status.disorder("status", "headwayRatio"))


V1 = f"WITH {LATEST_CTE} SELECT headwayGroup, recordId, status, {_DISORDER} AS disorder FROM latest WHERE windowEnd >= (SELECT max(windowEnd) FROM route_headways) - INTERVAL 10 MINUTE"


@query("v_1", V1)
def view_routes(spark: SparkSession, d: str) -> DataFrame:
    return live_routes(spark, d).select("headwayGroup", "recordId", "status", "disorder").orderBy(F.desc("disorder"), "headwayGroup")


@query("v_2", f"WITH {LATEST_CTE} SELECT headwayGroup, recordId, windowEnd FROM latest WHERE headwayGroup = '15:0'")
def view_route(spark: SparkSession, d: str) -> DataFrame:
    return state.newest(RH(spark, d).filter("headwayGroup = '15:0' and windowEnd is not null"), "headwayGroup", "windowEnd", "emittedAt", "recordId").select("headwayGroup", "recordId", "windowEnd")


@query("v_3", f"WITH {EPISODES_CTE} SELECT episodeId, worstStatus, startedAt FROM full_ WHERE endedAt IS NULL")
def view_alerts(spark: SparkSession, d: str) -> DataFrame:
    return all_episodes(spark, d).filter("endedAt is null").select("episodeId", "worstStatus", "startedAt").orderBy(F.desc(status.severity("worstStatus")), "startedAt", "episodeId")


@query("so_2", f"WITH {EPISODES_CTE} SELECT CAST(row_number() OVER (ORDER BY CASE WHEN worstStatus LIKE 'SEVERE%' THEN 2 ELSE 1 END DESC, startedAt, episodeId) AS INTEGER) AS place, episodeId FROM full_ WHERE endedAt IS NULL")
def open_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The order of the open episodes, of which a group has one at most."""
    worst_first = Window.partitionBy().orderBy(F.desc(status.severity("worstStatus")), "startedAt", "episodeId")
    return all_episodes(spark, d).filter("endedAt is null").select(F.row_number().over(worst_first).alias("place"), "episodeId")


_HISTORY = f"WITH {EPISODES_CTE} SELECT episodeId, endedAt FROM full_ WHERE endedAt IS NOT NULL ORDER BY endedAt DESC, episodeId LIMIT {{n}}"


def history(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """Closed episodes, newest first; the limit is held between 1 and the largest allowed."""
    n = max(1, min(CONFIG.history_most, limit))
    return all_episodes(spark, d).filter("endedAt is not null").select("episodeId", "endedAt").orderBy(F.desc("endedAt"), "episodeId").limit(n)


@query("v_4", _HISTORY.format(n=50))
def view_history(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d, CONFIG.history_default)


@query("so_3", _HISTORY.format(n=500))
def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d, 10_000)


VEHICLES_CTE = f"""vlast AS (SELECT upper(trim(vehicleId)) AS vehicle, first(deliveryId ORDER BY "timestamp" DESC, deliveryId DESC) AS deliveryId, max("timestamp") AS t, first(routeId ORDER BY "timestamp" DESC, deliveryId DESC) AS routeId FROM vehicle_positions WHERE "timestamp" <= receivedAt + INTERVAL 2 MINUTE GROUP BY 1),
  vlive AS (SELECT * FROM vlast WHERE t >= (SELECT max(t) FROM vlast) - INTERVAL 5 MINUTE)"""


def latest_vehicles(spark: SparkSession, d: str) -> DataFrame:
    v = VP(spark, d).filter("timestamp <= receivedAt + interval 2 minutes").select(ids.normal_id("vehicleId").alias("vehicle"), "timestamp", "deliveryId", "routeId")
    return state.newest(v, "vehicle", "timestamp", "deliveryId")


def live_vehicles(spark: SparkSession, d: str) -> DataFrame:
    v = latest_vehicles(spark, d)
    return state.live(v, "timestamp", latest_of(v, "timestamp"), CONFIG.vehicle_ttl)


@query("v_5", f"WITH {VEHICLES_CTE} SELECT vehicle, deliveryId, routeId FROM vlive")
def view_vehicles(spark: SparkSession, d: str) -> DataFrame:
    return live_vehicles(spark, d).select("vehicle", "deliveryId", "routeId").orderBy("vehicle")


@query("st_6", f"WITH {VEHICLES_CTE} SELECT vehicle, deliveryId FROM vlast")
def latest_position(spark: SparkSession, d: str) -> DataFrame:
    return latest_vehicles(spark, d).select("vehicle", "deliveryId")


@query("st_7", f"WITH {VEHICLES_CTE} SELECT CAST(count(*) AS BIGINT) AS evicted FROM vlast WHERE vehicle NOT IN (SELECT vehicle FROM vlive)")
def eviction(spark: SparkSession, d: str) -> DataFrame:
    v = latest_vehicles(spark, d)
    return v.join(live_vehicles(spark, d), "vehicle", "left_anti").agg(F.count("*").alias("evicted"))


def counters(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts."""
    e = all_episodes(spark, d)
    return one_row(
        live_routes(spark, d).agg(F.count("*").alias("routes")), live_vehicles(spark, d).agg(F.count("*").alias("vehicles")), e.agg(F.count_if(F.col("endedAt").isNull()).alias("openAlerts"), F.count("*").alias("openedTotal")),
        RH(spark, d).agg(F.count("*").alias("records"), F.max("windowEnd").alias("newest")), episodes.accepted(RH(spark, d)).agg(F.count("*").alias("accepted")),
    )


V7 = f"""WITH {EPISODES_CTE}, {VEHICLES_CTE}, {LATEST_CTE} SELECT (SELECT CAST(count(*) AS BIGINT) FROM latest WHERE windowEnd >= (SELECT max(windowEnd) FROM route_headways) - INTERVAL 10 MINUTE) AS routes,
  (SELECT CAST(count(*) AS BIGINT) FROM vlive) AS vehicles, (SELECT CAST(count(*) AS BIGINT) FROM full_ WHERE endedAt IS NULL) AS "openAlerts", (SELECT CAST(count(*) AS BIGINT) FROM full_) AS "openedTotal",
  (SELECT CAST(count(*) AS BIGINT) FROM route_headways) AS records, (SELECT max(windowEnd) FROM route_headways) AS newest, (SELECT CAST(count(*) AS BIGINT) FROM acc) AS accepted"""


@query("v_7", V7)
def view_status(spark: SparkSession, d: str) -> DataFrame:
    return counters(spark, d)


@query("ag_21", V7.replace("WITH ", f"WITH {OUTCOME_CTE}, ", 1) + """, (SELECT CAST(count(*) FILTER (outcome = 'STALE') AS BIGINT) FROM outcomes) AS stale, (SELECT CAST(count(*) FILTER (vehicleId IS NULL OR tripId IS NULL) AS BIGINT) FROM vehicle_positions) AS incomplete""")
def rollup_counters(spark: SparkSession, d: str) -> DataFrame:
    """The status counters with those of the ping store and of the log's filter."""
    stale = ping_outcomes(spark, d).agg(F.count_if(F.col("outcome") == "STALE").alias("stale"))
    return one_row(counters(spark, d), stale, VP(spark, d).agg(F.count_if(F.col("vehicleId").isNull() | F.col("tripId").isNull()).alias("incomplete")))


_V6 = f"""WITH {EPISODES_CTE}, {VEHICLES_CTE}, {LATEST_CTE}, {"counted AS (" + V7[V7.index("SELECT (SELECT"):] + ")"}
  SELECT counted.*, (SELECT string_agg(headwayGroup || '=' || recordId, ',' ORDER BY headwayGroup) FROM latest WHERE windowEnd >= (SELECT max(windowEnd) FROM route_headways) - INTERVAL 10 MINUTE) AS "routeViews",
    (SELECT string_agg(episodeId, ',' ORDER BY episodeId) FROM full_ WHERE endedAt IS NULL) AS alerts, (SELECT string_agg(vehicle || '=' || deliveryId, ',' ORDER BY vehicle) FROM vlive) AS "vehicleViews", epoch_ms(newest) AS sequence FROM counted"""


@query("v_6", _V6)
def view_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """One row: live routes, open alerts, live vehicles and counters. What it collects is bounded by the fleet."""
    def pack(df: DataFrame, name: str, text) -> DataFrame:
        got = df.agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias(name))
        return got.select(F.when(F.col(name) != "", F.col(name)).alias(name))

    pair = lambda a, b: F.concat_ws("=", a, F.col(b).cast("string"))
    out = one_row(
        counters(spark, d), pack(view_routes(spark, d), "routeViews", pair("headwayGroup", "recordId")), pack(view_alerts(spark, d), "alerts", F.col("episodeId")), pack(view_vehicles(spark, d), "vehicleViews", pair("vehicle", "deliveryId"))
    )
    return out.withColumn("sequence", F.unix_millis(F.col("newest").cast("timestamp")))


_INV = f"""WITH {LATEST_CTE}, x AS (SELECT unnest(layoverVehicles) AS vehicle, 'LAYOVER' AS status, headwayGroup, 0 AS kind FROM latest UNION ALL SELECT unnest(orderedVehicles), status, headwayGroup, 1 FROM latest WHERE status IS NOT NULL)
  SELECT vehicle, first(status ORDER BY headwayGroup DESC, kind DESC) AS status FROM x GROUP BY 1"""


@query("op_inv", _INV)
def inversion(spark: SparkSession, d: str) -> DataFrame:
    """Status of every vehicle by its group's newest record; the last group in order wins, and in it the moving vehicles."""
    r = latest_records(spark, d)
    away = r.select(F.explode("layoverVehicles").alias("vehicle"), F.lit("LAYOVER").alias("status"), "headwayGroup", F.lit(0).alias("kind"))
    moves = r.filter("status is not null").select(F.explode("orderedVehicles").alias("vehicle"), "status", "headwayGroup", F.lit(1).alias("kind"))
    return state.newest(away.unionByName(moves), "vehicle", "headwayGroup", "kind").select("vehicle", "status")


@query("op_flag", f"WITH {VEHICLES_CTE}, {LATEST_CTE} SELECT vehicle FROM vlast WHERE vehicle IN (SELECT unnest(worstPairVehicles) FROM latest WHERE status IN {ALERT_SQL})")
def flagged(spark: SparkSession, d: str) -> DataFrame:
    named = latest_records(spark, d).filter(status.alertable("status")).select(F.explode("worstPairVehicles").alias("vehicle"))
    return latest_vehicles(spark, d).select("vehicle").join(named, "vehicle", "left_semi")
