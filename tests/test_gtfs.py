"""A small GTFS archive, read the way a whole one is."""

import zipfile

import pytest

from tramline.operators import resolve
from tramline.sources import gtfs

ROUTES = 'route_id,agency_id,route_short_name,route_long_name,route_desc,route_type,route_url,route_color\n26903,M,1,One,,3,,\n26913,M,15,"Clifton Road, Candler Road",,3,,367AA8\n\n27457,M,A,Rail,,1,,\n'
TRIPS = "route_id,service_id,trip_id,trip_headsign,direction_id,shape_id\n26903,5,10001,x,0,SHAPE_A\n26903,5,10002,x,1,SHAPE_B\n26913,5, 10003 ,x,0,SHAPE_A\n26913,5,10004,x,0,\n26913,5,10005,x,7,SHAPE_A\n"
SHAPES = "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled\n" + "".join(f"SHAPE_A,{33.75 + 0.001 * k},-84.39,{k + 1},{d}\n" for k, d in enumerate(("0", "0.1113", "0.2227", "0.3340"))) + "".join(f"SHAPE_B,{33.76 + 0.001 * k},-84.4,{k + 1},\n" for k in range(3)) + "SHAPE_C,33.7,-84.4,1,0\n"
STOPS = "trip_id,arrival_time,departure_time,stop_sequence\n10001,08:40:00,08:40:00,9\n10001,08:00:00,,1\n10001,08:20:00,08:21:00,5\n10003,25:00:00,25:00:00,1\n10003,24:00:00,24:00:00,2\n10009,01:00:00,01:00:00,1\n"
CALENDAR = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n5,1,1,1,1,1,0,0,20260627,20260821\n"


def archive(path, bom="", **files):
    with zipfile.ZipFile(path, "w") as z:
        for n, text in files.items():
            z.writestr(f"{n}.txt", bom + text)
    return str(path)


@pytest.mark.parametrize("bom", ["", "﻿"])
def test_archive(spark, tmp_path, bom):
    a = archive(tmp_path / "f.zip", bom, routes=ROUTES, trips=TRIPS, shapes=SHAPES, stop_times=STOPS, calendar=CALENDAR)
    s = gtfs.load(spark, a, str(tmp_path / "stage"))
    assert s.routes.count() == 3 and s.trips.count() == 3
    fifteen = s.routes.filter("shortName = '15'").first()
    assert (fifteen.routeId, fifteen.longName, fifteen.routeType, fifteen.colorHex) == ("26913", "Clifton Road, Candler Road", 3, "367AA8")
    lengths = {r.shapeId: r.shapeLengthMetres for r in s.lines.collect()}
    assert lengths == {"SHAPE_A": pytest.approx(334.0, abs=1), "SHAPE_B": pytest.approx(222.4, abs=1)}
    got = s.scheduled.collect()
    assert [(r.headwayGroup, r.tripId, r.startSeconds, r.endSeconds) for r in got] == [("1:0", "10001", 28800, 31200)]
    assert s.calendar.first().days == [0, 1, 2, 3, 4] and s.exceptions is None
    shapes = s.points.groupBy("shapeId").agg(__import__("pyspark").sql.functions.collect_list(__import__("pyspark").sql.functions.struct("seq", "lat", "lon", "dist_m")).alias("pts"))
    pings = spark.createDataFrame([("15", "10003"), ("15", "nope"), ("15", None), ("15", "10004")], "routeId string, tripId string")
    assert [r.headwayGroup for r in resolve.resolve(pings, s.trips.selectExpr("*", "1 as feedRow"), shapes, s.routes).collect()] == ["15:0"]


def test_missing_file_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="trips.txt"):
        gtfs.load(spark, archive(tmp_path / "g.zip", routes=ROUTES, shapes=SHAPES), str(tmp_path / "s"))


def test_snapshot_cache_keeps_the_old_one():
    now, made = [0.0], []

    def loader():
        if len(made) == 1:
            made.append(None)
            raise OSError
        made.append(len(made))
        return made[-1]

    c = gtfs.SnapshotCache(loader, 10, 100, lambda: now[0])
    assert c.get() == 0
    now[0] = 11
    assert c.get() == 0  # the reload failed
    assert c.get() == 2
    c.invalidate()
    assert c.get() == 3


def test_conditional_download(tmp_path):
    import io

    class Answer(io.BytesIO):
        status, headers = 200, {"Last-Modified": "Mon, 03 Aug 2026 10:00:00 GMT"}

    to, asked = str(tmp_path / "feed.zip"), []

    def opener(request, status=200):
        asked.append(request.get_header("If-modified-since"))
        a = Answer(b"data")
        a.status = status
        return a

    assert gtfs.fetch("http://x/", to, opener) == "fresh" and open(to, "rb").read() == b"data"
    assert gtfs.fetch("http://x/", to, lambda r: opener(r, 304)) == "unchanged" and asked[-1] == "Mon, 03 Aug 2026 10:00:00 GMT"

    def broken(request):
        raise OSError

    assert gtfs.fetch("http://x/", to, broken) == "stale"
    with pytest.raises(OSError):
        gtfs.fetch("http://x/", str(tmp_path / "none"), broken)
