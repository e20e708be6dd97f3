"""Queries of the data-cleaning operators over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import anomaly, dedup, late, orphans, trips
from tramline.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeated_deliveries(table(spark, d, "vehicle_positions"))


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    return dedup.ping_ranges(table(spark, d, "vehicle_positions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.transit_orphans(table(spark, d, "vehicle_positions"), table(spark, d, "gtfs_trips"), table(spark, d, "gtfs_shapes"))
    return found.select("src", "record_id", "period", "state")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.transit_orphans(table(spark, d, "vehicle_positions"), table(spark, d, "gtfs_trips"), table(spark, d, "gtfs_shapes")))


def p2_signed_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.signed_counts(table(spark, d, "vehicle_positions"), "tripId", table(spark, d, "gtfs_trips"), "tripId").filter("refs > 0 and existing = 0")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pings = late.events(table(spark, d, "vehicle_positions"), "vehicle_positions", "deliveryId", "timestamp", "receivedAt")
    return late.late_events(pings.unionByName(late.events(table(spark, d, "route_headways"), "route_headways", "recordId", "windowEnd", "emittedAt")))


def p3_hourly(spark: SparkSession, d: str) -> DataFrame:
    both = late.released(table(spark, d, "vehicle_positions"), "vehicle_positions", "deliveryId", "timestamp", "receivedAt", "speedMetersPerSecond").unionByName(
        late.released(table(spark, d, "route_headways"), "route_headways", "recordId", "windowEnd", "emittedAt", "minGapMetres")
    )
    return both.withColumns({c: F.round(c, 4) for c in ("provisional_avg", "final_avg")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    readings = anomaly.transit_readings(table(spark, d, "vehicle_positions"), table(spark, d, "shape_projections"))
    return anomaly.anomalies(readings).select("src", "record_id")


def p4_risk(spark: SparkSession, d: str) -> DataFrame:
    """The same readings judged by the fitted cut-offs at fixed risk alone."""
    readings = anomaly.transit_readings(table(spark, d, "vehicle_positions"), table(spark, d, "shape_projections"))
    return anomaly.anomalies(readings, confirm=False)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return trips.stops_and_trips(table(spark, d, "vehicle_positions")).select("vehicle_id", "kind", "start_s", "end_s")


def p5_weighed(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips of the best path by duration, emission and entry odds, with durations and distances."""
    t = trips.stops_and_trips(table(spark, d, "vehicle_positions"), trips.WEIGHED)
    return t.select("vehicle_id", "kind", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), F.round("metres", 1).alias("metres"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranges, p2_found, p2_report, p2_signed_counts, p3_found, p3_hourly, p4_found, p4_risk, p5_found, p5_weighed)}

_NORMAL = "upper(trim(vehicleId, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))"
_BARE = "trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))"
_KEPT = f"""kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY CASE WHEN {_NORMAL} <> '' AND "timestamp" IS NOT NULL THEN {_NORMAL} END,
                   CASE WHEN {_NORMAL} <> '' AND "timestamp" IS NOT NULL THEN CAST(floor(epoch_us("timestamp") / 1000000) AS BIGINT) END,
                   CASE WHEN {_NORMAL} <> '' AND "timestamp" IS NOT NULL THEN NULL ELSE coalesce(vehicleId, chr(0)) END,
                   CASE WHEN {_NORMAL} <> '' AND "timestamp" IS NOT NULL THEN NULL ELSE "timestamp" END
      ORDER BY receivedAt NULLS FIRST, deliveryId) AS rn,
      {_NORMAL} AS vehicle
    FROM vehicle_positions) WHERE rn = 1)"""


def _orphan_sql(src: str, table_: str, record: str, key: str, at: str, to: str, to_key: str) -> str:
    k, tk = _BARE.format(c=f"r.{key}"), _BARE.format(c=to_key)
    return f"""
  SELECT '{src}' AS src, {record} AS record_id, strftime(r."{at}", '%Y-%m-%d') AS period,
    CASE WHEN g.k IS NULL THEN 'missing' WHEN g.first_loaded > r."{at}" THEN 'late' ELSE 'deleted' END AS state, {k} AS key
  FROM {table_} r LEFT JOIN (SELECT {tk} AS k, min(loadedAt) AS first_loaded FROM {to} WHERE {tk} <> '' GROUP BY 1) g ON {k} = g.k
  WHERE {k} <> '' AND r."{at}" IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM {to} x WHERE {_BARE.format(c='x.' + to_key)} = {k} AND x.loadedAt <= r."{at}" AND (x.deletedAt IS NULL OR r."{at}" < x.deletedAt))"""


_ORPHANS = _orphan_sql("vehicle_positions", "vehicle_positions", "deliveryId", "tripId", "timestamp", "gtfs_trips", "tripId") + "\n  UNION ALL" + _orphan_sql("gtfs_trips", "gtfs_trips", "feedRow", "shapeId", "loadedAt", "gtfs_shapes", "shapeId")


def _late_sql(src: str, record: str, event: str, arrival: str) -> str:
    end = f"""(date_trunc('hour', "{event}") + INTERVAL 1 HOUR)"""
    return f"""
  SELECT '{src}' AS src, {record} AS record_id, CASE WHEN "{arrival}" >= {end} + INTERVAL 6 HOUR THEN 'dropped' ELSE 'corrects' END AS verdict
  FROM {src} WHERE "{arrival}" >= {end} + INTERVAL 2 MINUTE"""


def _hourly_sql(src: str, record: str, event: str, arrival: str, value: str) -> str:
    end = f"""(date_trunc('hour', "{event}") + INTERVAL 1 HOUR)"""
    parts = []
    for name, cond in (("provisional", "verdict = 'in_time'"), ("final", "verdict <> 'dropped'")):
        parts.append(
            f"""CAST(count_if({cond}) AS BIGINT) AS {name}_n, round(avg(v) FILTER ({cond}), 4) AS {name}_avg,
      first(v ORDER BY e, id) FILTER ({cond} AND v IS NOT NULL) AS {name}_first, first(v ORDER BY e DESC, id DESC) FILTER ({cond} AND v IS NOT NULL) AS {name}_last"""
        )
    return f"""
  SELECT '{src}' AS src, date_trunc('hour', e) AS period, {', '.join(parts)},
    CAST(count_if(verdict = 'corrects') AS BIGINT) AS corrects, CAST(count_if(verdict = 'dropped') AS BIGINT) AS dropped
  FROM (SELECT {record} AS id, "{event}" AS e, CASE WHEN NOT isnan({value}) THEN {value} END AS v,
      CASE WHEN "{arrival}" >= {end} + INTERVAL 6 HOUR THEN 'dropped' WHEN "{arrival}" >= {end} + INTERVAL 2 MINUTE THEN 'corrects' ELSE 'in_time' END AS verdict
    FROM {src} WHERE "{event}" IS NOT NULL AND "{arrival}" IS NOT NULL) GROUP BY 1, 2"""


def _metres(a: str, b: str) -> str:
    h = f"pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)"
    return f"(2 * 6371008.8 * asin(least(1.0, sqrt({h}))))"


# Of every ping the end of its run within 50 m; then a walk over each track, from the end of every stop or to the next ping.
_STOPS = f"""WITH RECURSIVE {_KEPT}, sound AS (
    SELECT vehicle, epoch_us("timestamp") AS t, {{{{'lat': latitude, 'lon': longitude}}}} AS p FROM kept
    WHERE vehicle <> '' AND "timestamp" <= receivedAt + INTERVAL 2 MINUTE AND latitude BETWEEN 33 AND 35 AND longitude BETWEEN -86 AND -83),
  near AS (SELECT *, lag(p) OVER w AS p0, lag(t) OVER w AS t0, lead(p) OVER w AS p1, lead(t) OVER w AS t1 FROM sound WINDOW w AS (PARTITION BY vehicle ORDER BY t)),
  stays AS (SELECT vehicle, t, p FROM near WHERE NOT (coalesce({_metres('p0', 'p')} > 60 * (t - t0) / 1e6, false) AND coalesce({_metres('p', 'p1')} > 60 * (t1 - t) / 1e6, false))),
  gaps AS (SELECT *, lag(p) OVER w AS p0, coalesce(t - lag(t) OVER w > 1200000000, true) AS gap FROM stays WINDOW w AS (PARTITION BY vehicle ORDER BY t)),
  tracks AS (SELECT *, sum(gap::INT) OVER (PARTITION BY vehicle ORDER BY t) AS track FROM gaps),
  pts AS (SELECT vehicle, track, t, p, row_number() OVER w AS n, count(*) OVER (PARTITION BY vehicle, track) AS size, sum(CASE WHEN gap THEN 0 ELSE {_metres('p0', 'p')} END) OVER w AS way FROM tracks WINDOW w AS (PARTITION BY vehicle, track ORDER BY t)),
  outs AS (SELECT a.vehicle, a.track, a.n, min(b.n) AS out FROM pts a JOIN pts b ON a.vehicle = b.vehicle AND a.track = b.track AND b.n > a.n AND {_metres('a.p', 'b.p')} > 50 GROUP BY 1, 2, 3),
  runs AS (SELECT pts.*, coalesce(out, size + 1) - 1 AS e FROM pts LEFT JOIN outs USING (vehicle, track, n)),
  ways AS (SELECT r.*, x.t AS te, x.t - r.t >= 300000000 AS stop FROM runs r JOIN pts x ON x.vehicle = r.vehicle AND x.track = r.track AND x.n = r.e),
  walk AS (SELECT vehicle, track, n, e, stop FROM ways WHERE n = 1
    UNION ALL SELECT y.vehicle, y.track, y.n, y.e, y.stop FROM walk w JOIN ways y ON y.vehicle = w.vehicle AND y.track = w.track AND y.n = CASE WHEN w.stop THEN w.e + 1 ELSE w.n + 1 END),
  marks AS (SELECT vehicle, track, n AS a, e AS b FROM walk WHERE stop UNION ALL SELECT DISTINCT vehicle, track, 1, 1 FROM pts UNION ALL SELECT DISTINCT vehicle, track, size, size FROM pts),
  legs AS (SELECT vehicle, track, b AS a, lead(a) OVER (PARTITION BY vehicle, track ORDER BY a, b) AS b FROM marks)
  SELECT vehicle AS vehicle_id, 'stop' AS kind, CAST(floor(t / 1e6) AS BIGINT) AS start_s, CAST(floor(te / 1e6) AS BIGINT) AS end_s FROM ways JOIN (SELECT vehicle, track, n FROM walk WHERE stop) USING (vehicle, track, n)
  UNION ALL SELECT l.vehicle, 'trip', CAST(floor(x.t / 1e6) AS BIGINT), CAST(floor(y.t / 1e6) AS BIGINT) FROM legs l JOIN pts x ON x.vehicle = l.vehicle AND x.track = l.track AND x.n = l.a
    JOIN pts y ON y.vehicle = l.vehicle AND y.track = l.track AND y.n = l.b WHERE y.way - x.way >= 500""".replace("{{", "{").replace("}}", "}")


ORACLES = {
    "p5_found": _STOPS,
    "p1_found": f"WITH {_KEPT} SELECT deliveryId AS delivery_id FROM vehicle_positions WHERE deliveryId NOT IN (SELECT deliveryId FROM kept)",
    "p1_ranges": f"""WITH {_KEPT}, n AS (SELECT DISTINCT vehicle AS producer, CAST(floor(epoch_us("timestamp") / 1000000) AS BIGINT) AS s FROM kept WHERE vehicle <> '' AND "timestamp" IS NOT NULL),
  b AS (SELECT producer, CAST(floor(s / 3600.0) AS BIGINT) AS block, s FROM n),
  i AS (SELECT *, s - row_number() OVER (PARTITION BY producer, block ORDER BY s) AS island FROM b)
  SELECT producer, block, min(s) AS lo, max(s) AS hi FROM i GROUP BY producer, block, island""",
    "p2_found": f"SELECT src, record_id, period, state FROM ({_ORPHANS})",
    "p2_report": f"""SELECT src, period, state, CAST(count(*) AS BIGINT) AS refs, CAST(count(DISTINCT key) AS BIGINT) AS keys FROM ({_ORPHANS}) GROUP BY 1, 2, 3""",
    "p2_signed_counts": f"""WITH r AS (SELECT {_BARE.format(c='tripId')} AS key, count(*) AS refs FROM vehicle_positions GROUP BY 1),
  e AS (SELECT {_BARE.format(c='tripId')} AS key, count(*) FILTER (deletedAt IS NULL) AS existing FROM gtfs_trips GROUP BY 1)
  SELECT r.key, CAST(refs AS BIGINT) AS refs, CAST(coalesce(existing, 0) AS BIGINT) AS existing FROM r LEFT JOIN e ON r.key = e.key WHERE r.key <> '' AND coalesce(existing, 0) = 0""",
    "p3_found": _late_sql("vehicle_positions", "deliveryId", "timestamp", "receivedAt") + "\n  UNION ALL" + _late_sql("route_headways", "recordId", "windowEnd", "emittedAt"),
    "p3_hourly": _hourly_sql("vehicle_positions", "deliveryId", "timestamp", "receivedAt", "speedMetersPerSecond") + "\n  UNION ALL" + _hourly_sql("route_headways", "recordId", "windowEnd", "emittedAt", "minGapMetres"),
    "p4_found": f"""WITH {_KEPT}, r AS (
    SELECT 'vehicle_positions' AS src, vehicle AS source, deliveryId AS record_id, "timestamp" AS t, speedMetersPerSecond AS x, 60.0 AS top FROM kept
      WHERE "timestamp" <= receivedAt + INTERVAL 2 MINUTE AND speedMetersPerSecond IS NOT NULL
    UNION ALL SELECT 'shape_projections', vehicleId, projectionId, "timestamp", crossTrackMetres, 20000.0 FROM shape_projections WHERE crossTrackMetres IS NOT NULL),
  a AS (SELECT *, (isnan(x) OR x < 0 OR x > top) AS odd, lag(x) OVER (PARTITION BY src, source ORDER BY t, record_id) AS px FROM r),
  m AS (SELECT src, source, median(x) AS m, count(*) AS n FROM a WHERE NOT odd AND x <> 0 GROUP BY 1, 2),
  dd AS (SELECT a.src, a.source, median(abs(x - m)) AS d FROM a JOIN m ON a.src = m.src AND a.source = m.source WHERE NOT odd AND x <> 0 GROUP BY 1, 2),
  g AS (SELECT *, sum(CASE WHEN px IS NOT NULL AND px = x THEN 0 ELSE 1 END) OVER (PARTITION BY src, source ORDER BY t, record_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
  z AS (SELECT *, count(*) OVER (PARTITION BY src, source, run) AS long FROM g)
  SELECT z.src, z.record_id FROM z LEFT JOIN m ON z.src = m.src AND z.source = m.source LEFT JOIN dd ON z.src = dd.src AND z.source = dd.source
  WHERE odd OR (m.n >= 30 AND x > m.m + 8 * dd.d) OR (long >= 8 AND x <> 0)""",
}
