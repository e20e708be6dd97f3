"""Transit operators on small fixtures with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tramline.config import CONFIG
from tramline.functions import arrays, geo, status, times
from tramline.operators import gaps, schedule, snap

STEP = 111.195


def line(n, lon=-84.39):
    return [(k + 1, 33.75 + 0.001 * k, lon, STEP * k) for k in range(n)]


def place(spark, pts, positions, hint=None, window=CONFIG.hint_window_m):
    df = spark.createDataFrame([("A", pts, la, lo) for la, lo in positions], "shapeId string, pts array<struct<seq int, lat double, lon double, m double>>, lat double, lon double")
    lines = df.limit(1).select("shapeId", geo.segments(F.col("pts")).alias("segments"), F.size("pts").alias("pointCount"))
    got = snap.snap(df.select("shapeId", "lat", "lon", F.lit(hint).cast("double").alias("hint")), lines, "shapeId", "lat", "lon", hint="hint", window=window)
    return got.selectExpr("distanceAlongRouteMetres as along", "crossTrackMetres as off", "segmentIndex as k", "snappedLongitude as lon").collect()


def test_projection_on_a_line(spark):
    mid, off, before = place(spark, line(3), [(33.7505, -84.39), (33.7505, -84.389), (33.745, -84.39)])
    assert mid.along == pytest.approx(55.6, abs=0.5) and mid.off < 0.01 and mid.k == 0
    assert off.along == pytest.approx(55.6, abs=0.5) and off.off == pytest.approx(92.45, abs=0.2) and off.lon == pytest.approx(-84.39, abs=1e-9)
    assert before.along == 0 and before.off == pytest.approx(5 * STEP, abs=1)


def test_out_and_back_needs_a_hint(spark):
    pts = [(1, 33.75, -84.39, 0.0), (2, 33.759, -84.39, 1000.0), (3, 33.759, -84.38999, 1001.0), (4, 33.75, -84.38999, 2001.0)]
    at = [(33.7545, -84.389995)]
    assert place(spark, pts, at, 480, 200.0)[0].along == pytest.approx(500, abs=20)
    assert place(spark, pts, at, 1520, 200.0)[0].along == pytest.approx(1500, abs=20)
    assert place(spark, pts, at, 50_000, 100.0)[0].off < 50  # beyond the end: all of it
    assert place(spark, pts, at, -5_000, 100.0)[0].k == 0


def test_snap_both_ways(spark):
    lines = spark.createDataFrame([("A", [tuple(p) for p in line(20)])], "shapeId string, pts array<struct<seq int, lat double, lon double, m double>>").select("shapeId", geo.segments(F.col("pts")).alias("segments"), F.size("pts").alias("pointCount"))
    rows = [("A", 33.75 + 0.0007 * k, -84.39 + 0.0001 * k) for k in range(20)] + [("A", None, -84.3), ("A", float("nan"), -84.3), ("B", 33.7, -84.3), (None, 33.7, -84.3)]
    pings = spark.createDataFrame(rows, "tripShape string, latitude double, longitude double")
    one = sorted(map(str, (tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in snap.snap(pings, lines).collect())))
    two = sorted(map(str, (tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in snap.snap(pings, lines, max_points=1).collect())))
    assert one == two and len(one) == 24
    assert snap.snap(pings.limit(0), lines).count() == 0


SIGHT = "g string, vehicleId string, distanceMetres double, ts long, l double"


def both_forms(spark, sightings, length=None):
    df = spark.createDataFrame([("x", v, d, t, length) for v, d, t in sightings], SIGHT)
    rel = gaps.gaps(df, ["g"], F.col("l")).collect()
    arr = gaps.gaps_from_array(df.groupBy("g").agg(F.collect_list(F.struct("vehicleId", "distanceMetres", "ts")).alias("sightings"), F.max("l").alias("routeLengthMetres"))).collect()
    pick = lambda r: {k: r[k] for k in ("vehicleCount", "gapsMetres", "minGapMetres", "medianGapMetres", "maxGapMetres", "meanGapMetres", "orderedVehicles", "layoverVehicles", "worstPairVehicles")}
    assert [pick(r) for r in rel] == [pick(r) for r in arr]
    return pick(rel[0]) if rel else None


@pytest.mark.parametrize(
    ("seen", "length", "want"),
    [
        ([("a", 1000.0, 0), ("b", 2500.0, 0)], None, {"gapsMetres": [1500.0], "medianGapMetres": 1500.0}),
        ([("c", 14000.0, 0), ("a", 5000.0, 0), ("b", 5020.0, 0)], None, {"gapsMetres": [20.0, 8980.0], "worstPairVehicles": ["a", "b"]}),
        ([("bus-1", 1000.0, 0), ("bus-1", 1240.0, 45), ("bus-1", 1080.0, 15)], None, {"vehicleCount": 1, "gapsMetres": [], "minGapMetres": None}),
        ([("zebra", 500.0, 0), ("alpha", 500.0, 0)], None, {"orderedVehicles": ["alpha", "zebra"], "gapsMetres": [0.0]}),
        ([("a", 0.0, 0), ("b", 1000.0, 0), ("c", 2000.0, 0), ("d", 40000.0, 0)], None, {"medianGapMetres": 1000.0}),
        ([("3503", 0.0, 0), ("3694", 38.1, 0), ("3519", 10400.0, 0), ("3507", 13300.0, 0)], 21600.0, {"layoverVehicles": ["3503", "3694"], "gapsMetres": [2900.0]}),
        ([("s", 9000.0, 0), ("s", 9005.0, 9), ("t", 9100.0, 0), ("t", 9200.0, 9)], 21600.0, {"layoverVehicles": [], "vehicleCount": 2}),
        ([("p", 10.0, 0), ("p", 22.0, 1), ("p", 4.0, 2)], 21600.0, {"layoverVehicles": ["p"], "vehicleCount": 0}),
        ([("p", 0.0, 0), ("q", 38.1, 0)], None, {"gapsMetres": [38.1]}),
        ([("m", 5.0, 0), ("m", 400.0, 1)], 21600.0, {"layoverVehicles": []}),
        ([("n", None, 0), (None, 5.0, 0), ("m", 400.0, 1)], 21600.0, {"vehicleCount": 1}),
    ],
)
def test_gaps(spark, seen, length, want):
    got = both_forms(spark, seen, length)
    assert {k: got[k] for k in want} == want


def test_status_limits(spark):
    ratios = [0.0, 0.25, 0.26, 0.50, 0.51, 1.49, 1.50, 2.49, 2.50, 9.0, None]
    want = ["SEVERE_BUNCHING"] * 2 + ["BUNCHING"] * 2 + ["ON_SCHEDULE"] * 2 + ["GAPPING"] * 2 + ["SEVERE_GAPPING"] * 2 + [None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(ratios)], "k int, r double")
    assert [r.s for r in df.select("k", status.from_ratio("r").alias("s")).orderBy("k").collect()] == want


def test_times(spark):
    cases = {"06:20:00": 22800, "00:00:00": 0, "23:59:59": 86399, "24:00:00": 86400, "25:30:00": 91800, "26:15:30": 94530, " 6:20:00": 22800, "  6:20:00 ": 22800, "": -1, "not a time": -1, "12:99:00": -1}
    df = spark.createDataFrame(list(cases.items()) + [(None, -1)], "t string, want int").select("want", times.gtfs_seconds("t").alias("got"))
    assert all(r.want == r.got for r in df.collect())
    stamps = {"2026-08-15T14:31:00Z": 1786804260, "2026-08-15T14:31:00": 1786804260, "1786804260000": 1786804260, "2026-08-15T14:31:00.500Z": 1786804260, "yesterday": None, "": None}
    df = spark.createDataFrame(list(stamps.items()), "t string, want long").select("want", F.unix_seconds(times.lenient_instant("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_schedule_both_forms(spark):
    start = [25200 + 600 * k for k in range(12)] + [72000 + 2160 * k for k in range(6)]
    trips = spark.createDataFrame([("15:0", f"t{k}", "5", s, s + 2400, 12000.0) for k, s in enumerate(start)], "headwayGroup string, tripId string, serviceId string, startSeconds int, endSeconds int, shapeLengthMetres double")
    fri, sat = dt.date(2026, 8, 14), dt.date(2026, 8, 15)
    dates = spark.createDataFrame([(fri,), (sat,)], "date date")
    cal = spark.createDataFrame([("5", [0, 1, 2, 3, 4], dt.date(2026, 6, 27), dt.date(2026, 8, 21))], "serviceId string, days array<int>, start date, end date")
    none = spark.createDataFrame([], "serviceId string, date date, exceptionType int")
    on = schedule.active_services(dates, cal, none)
    moments = spark.createDataFrame([("15:0", fri, 28800), ("15:0", fri, 77400), ("15:0", sat, 28800), ("15:0", fri, 10800), ("9:0", fri, 28800)], "headwayGroup string, date date, second int")
    got = {(r.headwayGroup, r.date, r.second): (r.scheduledHeadwaySeconds, r.averageSpeedMps) for r in schedule.scheduled_headways(moments, trips, on).collect()}
    assert got == {("15:0", fri, 28800): (600, 5.0), ("15:0", fri, 77400): (2160, 5.0)}
    free = {r.date for r in schedule.scheduled_headways(moments, trips, None).collect()}
    assert free == {fri, sat}  # no calendar at all: nothing is filtered
    arr = moments.join(schedule.timetable(trips), "headwayGroup").join(on.groupBy("date").agg(F.collect_set("serviceId").alias("services")), "date").withColumn("s", schedule.scheduled_from_array(F.col("timetable"), F.col("second"), F.col("services"))).filter("s is not null")
    assert {(r.headwayGroup, r.date, r.second): (r.s.scheduledHeadwaySeconds, r.s.averageSpeedMps) for r in arr.collect()} == got
    swap = spark.createDataFrame([("5", fri, 2), ("3", fri, 1), ("3", fri, 2), ("9", sat, 1)], "serviceId string, date date, exceptionType int")
    assert {(r.date, r.serviceId) for r in schedule.active_services(dates, cal, swap).collect()} == {(sat, "9")}  # removing wins


def test_upper_and_true_median(spark):
    df = spark.createDataFrame([([600, 600, 2400],), ([4, 1],), ([],)], "x array<int>")
    assert [(r.u, r.m) for r in df.select(arrays.upper_median(F.col("x")).alias("u"), arrays.median(F.col("x")).alias("m")).collect()] == [(600, 600.0), (4, 2.5), (None, None)]
