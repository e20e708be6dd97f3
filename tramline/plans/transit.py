"""Queries of the scans, projections, filters, joins, sorts, sets and functions, each with its SQL.

Names follow the operator inventory. Figures that aren't exact in both engines are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline import schema
from tramline.functions import arrays, geo, ids, status, times
from tramline.functions.folds import before
from tramline.operators import resolve, state
from tramline.plans.registry import Registry
from tramline.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query

VP = lambda s, d: table(s, d, "vehicle_positions")
RH = lambda s, d: table(s, d, "route_headways")
TRIPS = lambda s, d: table(s, d, "gtfs_trips")
SHAPES = lambda s, d: table(s, d, "gtfs_shapes")
ROUTES = lambda s, d: table(s, d, "gtfs_routes")
ALERT_SQL = "('SEVERE_BUNCHING', 'BUNCHING', 'GAPPING', 'SEVERE_GAPPING')"
#: Half up on the decimal digits, as Spark rounds.
ROUNDED = ", ".join(f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {n}) AS DOUBLE) AS {a}" for x, n, a in (("minGapMetres", 0, "gap"), ("headwayRatio", 2, "ratio"), ("observedHeadwaySeconds / 60", 1, "minutes")))
#: The moment at which views are taken: the newest arrival in the table.
NOW_SQL = "(SELECT max(receivedAt) FROM vehicle_positions)"


# Scans ---------------------------------------------------------------------------------------------


@query("src_11", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS total FROM range(1, 11) t(x)")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 11).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query(
    "src_10",
    """SELECT CASE WHEN event_id % 7 = 0 THEN 'malformed' ELSE 'parsed' END AS outcome, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS total FROM events GROUP BY 1""",
)
def consumer_loop(spark: SparkSession, d: str) -> DataFrame:
    """Every record is parsed; broken ones are set apart and counted, and the rest goes on."""
    from tramline.sources.pings import split_malformed

    # every seventh record arrives cut off
    raw = table(spark, d, "events").select(F.when(F.expr("event_id % 7 = 0"), F.expr("substring(props, 1, 3)")).otherwise(F.col("props")).alias("value"))
    good, bad = split_malformed(raw, "value", "k long")
    return good.select(F.lit("parsed").alias("outcome"), "k").unionByName(bad.select(F.lit("malformed").alias("outcome"), F.lit(None).cast("long").alias("k"))).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("src_5", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT routeId) AS BIGINT) AS routes, CAST(sum(routeType) AS BIGINT) AS types, CAST(count(CASE WHEN longName LIKE '%,%' THEN 1 END) AS BIGINT) AS quoted FROM gtfs_routes""")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Routes written as CSV by header name (quoted commas, a missing column) and read back."""
    from tramline.session import fresh
    from tramline.sources.gtfs import read_csv

    out = fresh(spark, "routes-csv")
    ROUTES(spark, d).select(F.col("routeId").alias("route_id"), F.col("longName").alias("route_long_name"), F.col("routeType").alias("route_type")).write.mode("overwrite").option("header", True).option("escape", '"').csv(out)
    r = read_csv(spark, out, ["route_id", "route_long_name", "route_type", "route_color"])
    return r.agg(F.count("*").alias("n"), F.count_distinct("route_id").alias("routes"), F.sum(times.lenient_int("route_type", 0)).alias("types"), F.count_if(F.col("route_long_name").contains(",")).alias("quoted"))


# Projections ---------------------------------------------------------------------------------------


@query("prj_1", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json(F.col("props").cast("binary").cast("string"), "k long").alias("p")).select("event_id", "p.*")


@query("prj_2", "SELECT deliveryId, vehicleId, trim(tripId) AS tripId, latitude, longitude, \"timestamp\" AS ts FROM vehicle_positions WHERE vehicleId IS NOT NULL AND tripId IS NOT NULL")
def flatten(spark: SparkSession, d: str) -> DataFrame:
    packed = VP(spark, d).filter("vehicleId is not null and tripId is not null").select("deliveryId", F.struct("vehicleId", F.trim("tripId").alias("tripId"), "latitude", "longitude", "timestamp").alias("p"))
    return packed.select("deliveryId", "p.vehicleId", "p.tripId", "p.latitude", "p.longitude", F.col("p.timestamp").alias("ts"))


@query(
    "prj_3",
    """SELECT recordId, CASE WHEN routeLongName IS NULL OR trim(routeLongName) = '' THEN routeShortName ELSE routeShortName || ' ' || routeLongName END AS route_name,
  coalesce(nullif(CASE WHEN trim(routeLongName) <> '' THEN routeLongName END, ''), CASE WHEN trim(routeShortName) <> '' THEN routeShortName END, headwayGroup) AS record_name FROM route_headways""",
)
def display_name(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", status.route_name("routeShortName", "routeLongName").alias("route_name"), status.record_name("routeLongName", "routeShortName", "headwayGroup").alias("record_name"))


@query("prj_4", "SELECT recordId, {0} FROM route_headways".format(ROUNDED))
def rounding(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", F.round("minGapMetres", 0).alias("gap"), F.round("headwayRatio", 2).alias("ratio"), F.round(F.col("observedHeadwaySeconds") / 60, 1).alias("minutes"))


# Filters -------------------------------------------------------------------------------------------


def _filter(name: str, sql: str, tbl: str, key: str, cond) -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, tbl).filter(cond()).select(key)


_filter("flt_1", "SELECT deliveryId FROM vehicle_positions WHERE vehicleId IS NOT NULL AND tripId IS NOT NULL", "vehicle_positions", "deliveryId", lambda: F.expr("vehicleId is not null and tripId is not null"))
_filter("flt_3", "SELECT projectionId FROM shape_projections WHERE crossTrackMetres <= 150 AND NOT isnan(crossTrackMetres)", "shape_projections", "projectionId", lambda: F.expr("crossTrackMetres <= 150"))
_filter("flt_4", "SELECT recordId FROM route_headways WHERE vehicleCount >= 2", "route_headways", "recordId", lambda: F.expr("vehicleCount >= 2"))
_filter("flt_5", f"SELECT recordId FROM route_headways WHERE status IN {ALERT_SQL}", "route_headways", "recordId", lambda: status.alertable("status"))
_filter("flt_7", "SELECT routeId FROM gtfs_routes WHERE routeType = 3", "gtfs_routes", "routeId", lambda: F.expr("routeType = 3"))
_filter("flt_8", "SELECT feedRow FROM gtfs_trips WHERE directionId IN (0, 1) AND trim(shapeId) <> ''", "gtfs_trips", "feedRow", lambda: F.expr("directionId in (0, 1)") & (ids.bare("shapeId") != ""))
_filter("flt_12", "SELECT recordId FROM route_headways WHERE headwayGroup IS NOT NULL AND windowEnd IS NOT NULL", "route_headways", "recordId", lambda: F.expr("headwayGroup is not null and windowEnd is not null"))


@query("flt_2", """WITH t AS (SELECT DISTINCT trim(tripId) AS k FROM gtfs_trips WHERE directionId IN (0, 1) AND trim(shapeId) <> '')
  SELECT deliveryId FROM vehicle_positions WHERE trim(tripId) IN (SELECT k FROM t)""")
def resolved_only(spark: SparkSession, d: str) -> DataFrame:
    known = resolve.usable_trips(TRIPS(spark, d)).select("tripId")
    return VP(spark, d).select("deliveryId", ids.bare("tripId").alias("tripId")).join(known, "tripId", "left_semi").select("deliveryId")


@query("flt_6", """SELECT CAST(count(CASE WHEN status IN ('SEVERE_BUNCHING', 'BUNCHING') THEN 1 END) AS BIGINT) AS bunching,
  CAST(count(CASE WHEN status IN ('SEVERE_GAPPING', 'GAPPING') THEN 1 END) AS BIGINT) AS gapping FROM route_headways""")
def status_sets(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).agg(F.count_if(F.col("status").isin(*status.BUNCHING)).alias("bunching"), F.count_if(F.col("status").isin(*status.GAPPING)).alias("gapping"))


@query("flt_9", 'SELECT deliveryId, ("timestamp" >= receivedAt - INTERVAL 10 MINUTE AND "timestamp" <= receivedAt + INTERVAL 2 MINUTE) AS admitted FROM vehicle_positions')
def admission(spark: SparkSession, d: str) -> DataFrame:
    return VP(spark, d).select("deliveryId", state.admitted(F.col("timestamp"), F.col("receivedAt")).alias("admitted"))


@query("flt_10", """SELECT deliveryId, CASE WHEN vehicleId IS NULL OR routeId IS NULL OR "timestamp" IS NULL THEN 'missing'
  WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 THEN 'valid' ELSE 'rejected' END AS verdict FROM vehicle_positions""")
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    return VP(spark, d).select("deliveryId", F.when(F.expr("vehicleId is null or routeId is null or timestamp is null"), "missing").when(ok, "valid").otherwise("rejected").alias("verdict"))


@query("flt_11", "SELECT deliveryId, vehicleId FROM vehicle_positions WHERE routeId = '15'")
def by_route(spark: SparkSession, d: str) -> DataFrame:
    return VP(spark, d).filter(F.col("routeId") == "15").select("deliveryId", "vehicleId").orderBy("vehicleId")


# Joins ---------------------------------------------------------------------------------------------

TRIPS_CTE = """trips AS (SELECT * FROM (SELECT trim(tripId) AS tripId, routeId, serviceId, directionId, trim(shapeId) AS shapeId,
    row_number() OVER (PARTITION BY trim(tripId) ORDER BY feedRow DESC) AS rn FROM gtfs_trips WHERE trim(tripId) <> '' AND directionId IN (0, 1) AND trim(shapeId) <> '') WHERE rn = 1)"""
HAV = "2 * 6371008.8 * atan2(sqrt({h}), sqrt(1 - {h}))"
_H = "(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))"
POINTS_CTE = f"""raw_pts AS (SELECT trim(shapeId) AS shapeId, unnest(pts) AS p FROM gtfs_shapes),
  lag_pts AS (SELECT shapeId, p.seq AS seq, p.lat AS lat, p.lon AS lon, p.dist_m AS d, lag(p.lat) OVER w AS plat, lag(p.lon) OVER w AS plon, lag(p.dist_m) OVER w AS pd
    FROM raw_pts WINDOW w AS (PARTITION BY shapeId ORDER BY p.seq)),
  way_pts AS (SELECT *, coalesce({HAV.format(h=_H)}, 0) AS step, bool_or(d IS NULL OR isnan(d) OR coalesce(d < pd, false)) OVER (PARTITION BY shapeId) AS bad FROM lag_pts),
  points AS (SELECT shapeId, seq, lat, lon, CASE WHEN bad THEN sum(step) OVER (PARTITION BY shapeId ORDER BY seq) ELSE d END AS m FROM way_pts),
  shapes AS (SELECT shapeId, max_by(m, seq) AS len, count(*) AS n FROM points GROUP BY 1 HAVING count(*) >= 2)"""
RESOLVED_CTE = f"""{TRIPS_CTE}, {POINTS_CTE},
  resolved AS (SELECT v.*, t.shapeId AS tripShape, t.directionId AS tripDirection, coalesce(r.shortName, s.shortName) AS routeShortName,
      CASE WHEN r.shortName IS NOT NULL THEN r.longName ELSE s.longName END AS routeLongName, h.len AS shapeLengthMetres,
      coalesce(r.shortName, s.shortName) || ':' || t.directionId AS headwayGroup
    FROM vehicle_positions v JOIN trips t ON trim(v.tripId) = t.tripId JOIN shapes h ON h.shapeId = t.shapeId
    LEFT JOIN gtfs_routes r ON r.routeId = t.routeId LEFT JOIN gtfs_routes s ON s.shortName = v.routeId
    WHERE coalesce(r.shortName, s.shortName) IS NOT NULL)"""


@query("jn_1", f"WITH {RESOLVED_CTE} SELECT deliveryId, headwayGroup, routeShortName, routeLongName, tripDirection, tripShape, round(shapeLengthMetres, 2) AS shapeLengthMetres FROM resolved")
def resolve_ping(spark: SparkSession, d: str) -> DataFrame:
    r = resolve.resolve(VP(spark, d), TRIPS(spark, d), SHAPES(spark, d), ROUTES(spark, d))
    return r.select("deliveryId", "headwayGroup", "routeShortName", "routeLongName", "tripDirection", "tripShape", F.round("shapeLengthMetres", 2).alias("shapeLengthMetres"))


@query("jn_2", "SELECT v.deliveryId, r.routeId FROM vehicle_positions v JOIN (SELECT shortName, min(routeId) AS routeId FROM gtfs_routes WHERE shortName <> '' GROUP BY 1) r ON v.routeId = r.shortName")
def route_by_realtime_id(spark: SparkSession, d: str) -> DataFrame:
    r = resolve.first_by_short_name(ROUTES(spark, d), "routeId").select(F.col("shortName").alias("_s"), F.col("routeId").alias("_r"))
    v = VP(spark, d).select("deliveryId", "routeId")
    return v.join(resolve.small_side(r, resolve.MAX_TRIPS), v["routeId"] == r["_s"]).select("deliveryId", F.col("_r").alias("routeId"))


@query("jn_3", f"WITH {TRIPS_CTE}, {POINTS_CTE} SELECT t.tripId, t.directionId, r.shortName, round(s.len, 2) AS len FROM trips t LEFT JOIN gtfs_routes r ON r.routeId = t.routeId LEFT JOIN shapes s ON s.shapeId = t.shapeId")
def by_ids(spark: SparkSession, d: str) -> DataFrame:
    t = resolve.usable_trips(TRIPS(spark, d))
    lines = resolve.polylines(SHAPES(spark, d)).select("shapeId", "shapeLengthMetres")
    return t.join(ROUTES(spark, d).select("routeId", "shortName"), "routeId", "left").join(lines, "shapeId", "left").select("tripId", "directionId", "shortName", F.round("shapeLengthMetres", 2).alias("len"))


@query("jn_4", f"WITH {TRIPS_CTE}, {POINTS_CTE} SELECT t.tripId, r.shortName || ':' || t.directionId AS headwayGroup, round(s.len, 2) AS len FROM trips t JOIN gtfs_routes r ON r.routeId = t.routeId JOIN shapes s ON s.shapeId = t.shapeId WHERE r.shortName <> ''")
def schedule_join(spark: SparkSession, d: str) -> DataFrame:
    c = resolve.contexts(TRIPS(spark, d), SHAPES(spark, d), ROUTES(spark, d)).filter("shortName <> ''")
    return c.select("tripId", F.concat_ws(":", "shortName", F.col("directionId").cast("string")).alias("headwayGroup"), F.round("shapeLengthMetres", 2).alias("len"))


@query("jn_5", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def stop_times_of_trips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "orders").filter("o_orderstatus <> 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("jn_6", "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def broadcast_dimension(spark: SparkSession, d: str) -> DataFrame:
    n, r = (resolve.small_side(table(spark, d, t), resolve.MAX_SHAPES) for t in ("nation", "region"))
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("jn_9", f"""WITH {TRIPS_CTE}, {POINTS_CTE}, v AS (SELECT deliveryId, nullif(trim(tripId), '') AS k, routeId FROM vehicle_positions)
  SELECT v.deliveryId, CASE WHEN k IS NULL THEN 'no trip id' WHEN t.tripId IS NULL THEN 'unknown trip' WHEN s.shapeId IS NULL THEN 'no shape'
    WHEN r.routeId IS NULL AND rs.shortName IS NULL THEN 'unknown route' ELSE 'resolved' END AS outcome
  FROM v LEFT JOIN trips t ON v.k = t.tripId LEFT JOIN shapes s ON s.shapeId = t.shapeId LEFT JOIN gtfs_routes r ON r.routeId = t.routeId LEFT JOIN gtfs_routes rs ON rs.shortName = v.routeId""")
def anti_resolution(spark: SparkSession, d: str) -> DataFrame:
    from tramline.operators.quality import coverage

    return coverage(VP(spark, d), TRIPS(spark, d), SHAPES(spark, d), ROUTES(spark, d)).select("deliveryId", "outcome")


# Sets ----------------------------------------------------------------------------------------------


@query("se_1", "SELECT serviceId FROM gtfs_trips WHERE directionId = 0 UNION SELECT serviceId FROM gtfs_trips WHERE directionId = 1")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    t = TRIPS(spark, d)
    return t.filter("directionId = 0").select("serviceId").union(t.filter("directionId = 1").select("serviceId")).distinct()


@query("se_2", "SELECT DISTINCT routeId FROM vehicle_positions EXCEPT SELECT shortName FROM gtfs_routes WHERE routeType <> 3")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    removed = ROUTES(spark, d).filter("routeType <> 3").select(F.col("shortName").alias("routeId"))
    return VP(spark, d).select("routeId").distinct().join(removed, "routeId", "left_anti")


@query("se_3", "SELECT DISTINCT routeId FROM vehicle_positions")
def set_distinct(spark: SparkSession, d: str) -> DataFrame:
    return VP(spark, d).select("routeId").distinct()


@query("se_4", """SELECT DISTINCT upper(trim(vehicleId)) AS vehicle FROM vehicle_positions WHERE batchId % 2 = 0
  INTERSECT SELECT DISTINCT upper(trim(vehicleId)) FROM vehicle_positions WHERE batchId % 2 = 1""")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    v = VP(spark, d).select(ids.normal_id("vehicleId").alias("vehicle"), "batchId")
    half = lambda k: v.filter(F.col("batchId") % 2 == k).select("vehicle").distinct()
    return half(0).join(half(1), "vehicle")


# Functions -----------------------------------------------------------------------------------------

@query("fn_1", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 60 < 60 THEN (o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 60 END AS INTEGER) AS seconds FROM orders""")
def gtfs_time(spark: SparkSession, d: str) -> DataFrame:
    """Times written as H:MM:SS, with hours up to 29, and read back."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit(" "), (k % 30).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", times.gtfs_seconds(text).alias("seconds"))


@query("fn_2", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def gtfs_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", times.gtfs_date(F.date_format("o_orderdate", "yyyyMMdd")).cast("string").alias("day"))


@query("fn_3", "SELECT event_id, CAST(coalesce(TRY_CAST(substr(props, 7, 1) AS INTEGER), -1) AS INTEGER) AS i, coalesce(TRY_CAST(event_type AS DOUBLE), 0.5) AS x FROM events")
def lenient_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", times.lenient_int(F.substring("props", 7, 1), -1).alias("i"), times.lenient_double("event_type", 0.5).alias("x"))


@query("fn_4", "SELECT o_orderkey, (CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND isodow(o_orderdate) <= 5) AS runs FROM orders")
def weekday_predicate(spark: SparkSession, d: str) -> DataFrame:
    days = F.array(*[F.lit(k) for k in range(5)])
    runs = times.runs_on(F.to_date("o_orderdate"), days, F.lit("1995-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", runs.alias("runs"))


_FLAGS = [(0, "p_size % 2 = 1"), (1, "p_size % 3 = 0"), (2, "p_size % 5 < 2"), (3, "p_size > 25"), (4, "p_size % 7 = 1"), (5, "p_size < 10"), (6, "p_size % 11 > 5")]


@query("fn_5", "SELECT p_partkey, coalesce(array_to_string([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _FLAGS) + "], ','), '') AS days FROM part")
def day_columns(spark: SparkSession, d: str) -> DataFrame:
    """Seven day columns, each "1", "0" or padded, as a set of weekdays."""
    flags = [F.when(F.expr(c), " 1" if k % 2 else "1").otherwise("0") for k, c in _FLAGS]
    return table(spark, d, "part").select("p_partkey", F.array_join(times.day_set(*flags).cast("array<string>"), ",").alias("days"))


@query("fn_6", """SELECT recordId, strftime(x, '%Y-%m-%d') AS day, CAST(hour(x) * 3600 + minute(x) * 60 + second(x) AS INTEGER) AS seconds
  FROM (SELECT recordId, (windowEnd AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS x FROM route_headways)""")
def local_time(spark: SparkSession, d: str) -> DataFrame:
    x = times.local("windowEnd", "America/New_York")
    return RH(spark, d).select("recordId", F.to_date(x).cast("string").alias("day"), times.second_of_day(x).alias("seconds"))


STATUS_SQL = "CASE WHEN {r} <= 0.25 THEN 'SEVERE_BUNCHING' WHEN {r} <= 0.5 THEN 'BUNCHING' WHEN {r} >= 2.5 THEN 'SEVERE_GAPPING' WHEN {r} >= 1.5 THEN 'GAPPING' WHEN {r} IS NOT NULL THEN 'ON_SCHEDULE' END"


@query("fn_7", f"SELECT recordId, {STATUS_SQL.format(r='headwayRatio')} AS status FROM route_headways")
def ratio_status(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", status.from_ratio("headwayRatio").alias("status"))


@query("fn_8", "SELECT recordId, round(scheduledHeadwaySeconds * averageSpeedMps, 4) AS expected FROM route_headways")
def expected_spacing(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", F.round(F.col("scheduledHeadwaySeconds") * F.col("averageSpeedMps"), 4).alias("expected"))


@query("fn_9", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / greatest(1, l_quantity - 10), 8) AS speed FROM lineitem")
def trip_speed(spark: SparkSession, d: str) -> DataFrame:
    from tramline.operators.schedule import speed

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(speed(F.lit(10), F.col("l_quantity"), F.col("l_extendedprice")), 8).alias("speed"))


@query("fn_10", """SELECT recordId, round(minGapMetres / averageSpeedMps, 4) AS observed, round(CASE WHEN expectedSpacingMetres > 0 THEN minGapMetres / expectedSpacingMetres END, 6) AS ratio FROM route_headways""")
def observed_and_ratio(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select(
        "recordId", F.round(F.try_divide("minGapMetres", "averageSpeedMps"), 4).alias("observed"), F.round(F.when(F.col("expectedSpacingMetres") > 0, F.try_divide("minGapMetres", "expectedSpacingMetres")), 6).alias("ratio")
    )


@query("fn_11", f"""SELECT projectionId, round({HAV.format(h='h')}, 3) AS metres FROM (SELECT projectionId, pow(sin(radians(snappedLatitude - 33.75) / 2), 2)
  + cos(radians(33.75)) * cos(radians(snappedLatitude)) * pow(sin(radians(snappedLongitude + 84.39) / 2), 2) AS h FROM shape_projections)""")
def great_circle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shape_projections").select("projectionId", F.round(geo.haversine(F.lit(33.75), F.lit(-84.39), F.col("snappedLatitude"), F.col("snappedLongitude")), 3).alias("metres"))


@query("fn_12", "SELECT trim(shapeId) AS shapeId, p.seq AS seq, coalesce(p.dist_m, 'NaN'::DOUBLE) * 1000 AS metres FROM (SELECT shapeId, unnest(pts) AS p FROM gtfs_shapes)")
def kilometres(spark: SparkSession, d: str) -> DataFrame:
    from tramline.sources.gtfs import metres_of_km

    return SHAPES(spark, d).select(ids.bare("shapeId").alias("shapeId"), F.explode("pts").alias("p")).select("shapeId", "p.seq", metres_of_km(F.col("p.dist_m").cast("string")).alias("metres"))


@query("fn_13", "SELECT recordId, coalesce(maxGapMetres - minGapMetres < 25 AND (minGapMetres <= 250 OR minGapMetres >= routeLengthMetres - 250) AND routeLengthMetres > 0, false) AS away FROM route_headways")
def layover(spark: SparkSession, d: str) -> DataFrame:
    from tramline.operators.gaps import is_layover

    return RH(spark, d).select("recordId", is_layover(F.col("maxGapMetres") - F.col("minGapMetres"), F.col("minGapMetres"), F.col("routeLengthMetres")).alias("away"))


@query("fn_14", "SELECT recordId, round(CASE WHEN len(gapsMetres) > 0 THEN list_median(gapsMetres) END, 4) AS median FROM route_headways".replace("list_median(gapsMetres)", "list_aggregate(gapsMetres, 'median')"))
def array_median(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", F.round(arrays.median(F.col("gapsMetres")), 4).alias("median"))


_SEV = "CASE WHEN {s} IN ('SEVERE_BUNCHING', 'SEVERE_GAPPING') THEN 2 WHEN {s} IN ('BUNCHING', 'GAPPING') THEN 1 ELSE 0 END"


@query("fn_15", f"""SELECT recordId, CAST({_SEV.format(s='status')} AS INTEGER) AS severity,
  CASE WHEN {_SEV.format(s='status')} <> 1 THEN {_SEV.format(s='status')} > 1 ELSE coalesce(abs(headwayRatio - 1) > abs(0.4 - 1), false) END AS worse FROM route_headways""")
def severity(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", status.severity("status").alias("severity"), status.is_worse(F.col("status"), F.col("headwayRatio"), F.lit("BUNCHING"), F.lit(0.4)).alias("worse"))


@query("fn_16")
def shard(spark: SparkSession, d: str) -> DataFrame:
    """Rows per shard: every route lies in one shard. The hash is Spark's own."""
    return VP(spark, d).select("routeId", F.pmod(F.hash("routeId"), F.lit(8)).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("routeId").alias("routes"))


@query("fn_17", """SELECT event_id, form, CASE WHEN form = 'rubbish' THEN NULL WHEN form = 'millis' THEN date_trunc('millisecond', ts) WHEN form = 'zone' THEN date_trunc('second', ts) ELSE date_trunc('second', ts) END AS instant
  FROM (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'zone' WHEN 1 THEN 'plain' WHEN 2 THEN 'millis' ELSE 'rubbish' END AS form FROM events)""")
def instants(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("form", F.element_at(F.array(*[F.lit(x) for x in ("zone", "plain", "millis", "rubbish")]), (F.col("event_id") % 4 + 1).cast("int")))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("form") == "zone", F.concat(iso, F.lit("Z"))).when(F.col("form") == "plain", iso).when(F.col("form") == "millis", F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise("yesterday")
    return e.select("event_id", "form", times.lenient_instant(text).cast("timestamp_ntz").alias("instant"))


@query("fn_18", """SELECT deliveryId, vehicleId, latitude, "timestamp" FROM vehicle_positions""")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Encoded (nulls left out) and decoded by the declared schema, with an unknown field."""
    v = VP(spark, d)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.PING.fields]
    j = v.select("deliveryId", F.to_json(F.struct(*cols, F.lit(1).alias("unknown")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("j"))
    return j.select("deliveryId", F.from_json("j", schema.PING).alias("p")).select("deliveryId", "p.vehicleId", "p.latitude", F.col("p.timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("fn_19", """SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT "timestamp" AS t, lag("timestamp") OVER (PARTITION BY upper(trim(vehicleId)) ORDER BY receivedAt, deliveryId) AS p FROM vehicle_positions) WHERE t > p""")
def superseded(spark: SparkSession, d: str) -> DataFrame:
    v = VP(spark, d).select(ids.normal_id("vehicleId").alias("vehicle"), "timestamp", "receivedAt", "deliveryId")
    return before(v, ["vehicle"], ["receivedAt", "deliveryId"], lag_of={"last": F.col("timestamp")}).agg(F.count_if(F.col("timestamp") > F.col("last")).alias("n"))


@query("fn_20", "SELECT recordId, list_position(orderedVehicles, worstPairVehicles[1]) AS place, len(orderedVehicles) AS n, array_to_string(list_sort(orderedVehicles), ',') AS sorted FROM route_headways".replace("list_position(", "CAST(list_position(").replace("[1]) AS place", "[1]) AS INTEGER) AS place").replace("len(orderedVehicles) AS n", "CAST(len(orderedVehicles) AS INTEGER) AS n"))
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("orderedVehicles")
    return RH(spark, d).select("recordId", F.array_position(o, F.get("worstPairVehicles", F.lit(0))).cast("int").alias("place"), F.size(o).alias("n"), F.array_join(F.array_sort(o), ",").alias("sorted"))


@query("fn_21", "SELECT recordId, headwayGroup || '@' || CAST(epoch_ms(windowEnd) AS VARCHAR) AS id FROM route_headways")
def episode_ids(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", status.episode_id("headwayGroup", "windowEnd").alias("id"))


@query("fn_22", "SELECT recordId, CAST(floor(epoch(emittedAt)) - floor(epoch(windowStart)) AS BIGINT) AS seconds FROM route_headways")
def duration(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", (ids.seconds("emittedAt") - ids.seconds("windowStart")).alias("seconds"))


@query("fn_23", "SELECT recordId, round(averageSpeedMps * 2.23694, 1) AS mph, CASE WHEN minGapMetres >= 1000 THEN 'km' ELSE 'm' END AS unit FROM route_headways")
def formats(spark: SparkSession, d: str) -> DataFrame:
    return RH(spark, d).select("recordId", F.round(F.col("averageSpeedMps") * 2.23694, 1).alias("mph"), F.when(F.col("minGapMetres") >= 1000, "km").otherwise("m").alias("unit"))


# Sorts ---------------------------------------------------------------------------------------------


def _top(name: str, sql: str, run) -> None:
    query(name, sql)(run)


_DISORDER = f"CASE WHEN status IN {ALERT_SQL} AND headwayRatio IS NOT NULL THEN abs(headwayRatio - 1) ELSE -1 END"
_top("so_1", f"SELECT recordId, headwayGroup, {_DISORDER} AS disorder FROM route_headways", lambda s, d: RH(s, d).select("recordId", "headwayGroup", status.disorder("status", "headwayRatio").alias("disorder")).orderBy(F.desc("disorder"), "headwayGroup", "recordId"))
_top("so_4", f"SELECT recordId, headwayRatio FROM route_headways WHERE status IN {ALERT_SQL} ORDER BY headwayRatio, recordId LIMIT 12", lambda s, d: RH(s, d).filter(status.alertable("status")).select("recordId", "headwayRatio").orderBy("headwayRatio", "recordId").limit(12))
_top("so_5", "SELECT routeId, CAST(count(*) AS BIGINT) AS n FROM vehicle_positions GROUP BY 1 ORDER BY n DESC, routeId LIMIT 5", lambda s, d: VP(s, d).groupBy("routeId").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "routeId").limit(5))
_top("so_6", "SELECT projectionId, crossTrackMetres FROM shape_projections WHERE crossTrackMetres > 100 AND NOT isnan(crossTrackMetres) ORDER BY crossTrackMetres DESC, projectionId LIMIT 3", lambda s, d: table(s, d, "shape_projections").filter("crossTrackMetres > 100 and not isnan(crossTrackMetres)").select("projectionId", "crossTrackMetres").orderBy(F.desc("crossTrackMetres"), "projectionId").limit(3))
_top("so_7", "SELECT recordId, minGapMetres FROM route_headways WHERE minGapMetres IS NOT NULL ORDER BY minGapMetres, recordId LIMIT 8", lambda s, d: RH(s, d).filter("minGapMetres is not null").select("recordId", "minGapMetres").orderBy("minGapMetres", "recordId").limit(8))
_top("so_8", "SELECT routeId || ':' || directionId AS g, array_to_string(list_transform(list_sort(list(feedRow)), lambda x: CAST(x AS VARCHAR)), ',') AS rows FROM gtfs_trips GROUP BY 1",
     lambda s, d: TRIPS(s, d).groupBy(F.concat_ws(":", "routeId", F.col("directionId").cast("string")).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("feedRow")), lambda x: x.cast("string")), ",").alias("rows")))  # the feed's trips of one group
query("so_9")(lambda s, d: VP(s, d).select("deliveryId").limit(5))


# Sinks ---------------------------------------------------------------------------------------------


_PING_OUT = ["vehicleId", "routeId", "tripId", "directionId", "latitude", "longitude", "bearingDegrees", "speedMetersPerSecond", "timestamp"]
_NUMBERS = ("latitude", "longitude", "bearingDegrees", "speedMetersPerSecond")


@query("snk_3", "SELECT deliveryId, latitude IS NULL AS tombstone, " + ", ".join(f'CASE WHEN latitude IS NOT NULL{f" AND NOT isnan({c})" if c in _NUMBERS else ""} THEN "{c}" END AS "{c}"' for c in _PING_OUT) + " FROM vehicle_positions")
def serialise(spark: SparkSession, d: str) -> DataFrame:
    """Every field of a ping to JSON and back; pings without a latitude are tombstones, of which nothing comes back."""
    from tramline.sources.pings import json_value

    v = VP(spark, d)
    of = {f.name: f.dataType for f in schema.PING.fields}
    value = json_value(F.when(F.col("latitude").isNotNull(), F.struct(*[F.col(c).cast(of[c]).alias(c) for c in _PING_OUT])))
    back = v.select("deliveryId", value.isNull().alias("tombstone"), F.from_json(value, schema.PING).alias("p"))
    number = lambda c: F.when(~F.isnan(f"p.{c}"), F.col(f"p.{c}")) if c in _NUMBERS else F.col(f"p.{c}").cast("timestamp_ntz") if c == "timestamp" else F.col(f"p.{c}")
    return back.select("deliveryId", "tombstone", *[number(c).alias(c) for c in _PING_OUT])


@query("snk_5", f"""SELECT headwayGroup, recordId, {ROUNDED}, status
  FROM (SELECT * FROM route_headways WHERE status IN {ALERT_SQL} ORDER BY headwayRatio, recordId LIMIT 12)""")
def console(spark: SparkSession, d: str) -> DataFrame:
    from tramline.streaming.sinks import console_rows

    return console_rows(RH(spark, d), "recordId")


_RECORD_OUT = ["windowStart", "windowEnd", "routeShortName", "directionId", "vehicleCount", "minGapMetres", "scheduledHeadwaySeconds", "headwayRatio", "status"]


@query("snk_6", "SELECT recordId, headwayGroup AS key, " + ", ".join(f'"{c}"' for c in _RECORD_OUT) + ", array_to_string(orderedVehicles, ',') AS ordered, CAST(len(gapsMetres) AS INTEGER) AS gaps FROM route_headways")
def keyed_json(spark: SparkSession, d: str) -> DataFrame:
    """Whole window records as keyed JSON, and what a reader of the topic gets."""
    from tramline.streaming.sinks import keyed_json as keyed

    rows = keyed(RH(spark, d), "headwayGroup", [f.name for f in schema.RECORD.fields], keep=["recordId"])
    back = rows.select("recordId", "key", F.from_json("value", schema.RECORD).alias("r"))
    at = lambda c: F.col(f"r.{c}").cast("timestamp_ntz") if c.startswith("window") else F.col(f"r.{c}")
    return back.select("recordId", "key", *[at(c).alias(c) for c in _RECORD_OUT], F.array_join("r.orderedVehicles", ",").alias("ordered"), F.size("r.gapsMetres").alias("gaps"))
