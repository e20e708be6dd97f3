"""Stops and trips against a plain walk over every vehicle's pings."""

import math
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest

from tramline.operators.trips import WEIGHED, Track, decode_track, log_longer, log_normal, metres, run_end, stops_and_trips

SF = "/root/testdata/sf0.001"
SCHEMA = "deliveryId long, receivedAt timestamp_ntz, vehicleId string, latitude double, longitude double, timestamp timestamp_ntz"


def far(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h)))


def plain(rows):
    """rows: (deliveryId, receivedAt, vehicleId, lat, lon, timestamp)."""
    epoch = datetime(1970, 1, 1)
    kept = {}
    for i, received, v, lat, lon, t in rows:
        us = (t - epoch) // timedelta(microseconds=1)
        k = (v.strip().upper(), us // 1_000_000)
        if k not in kept or (received, i) < kept[k][:2]:
            kept[k] = (received, i, us, lat, lon, t)
    tracks = defaultdict(list)
    for (v, _), (received, _, us, lat, lon, t) in kept.items():
        if t <= received + timedelta(minutes=2) and lat is not None and lon is not None and 33 <= lat <= 35 and -86 <= lon <= -83:
            tracks[v].append((us, lat, lon))
    out = set()
    for v, ps in tracks.items():
        ps.sort()
        fast = [far(a, b) > 60 * (b[0] - a[0]) / 1e6 for a, b in zip(ps, ps[1:])]
        ps = [p for k, p in enumerate(ps) if not (0 < k < len(ps) - 1 and fast[k - 1] and fast[k])]
        pieces, cur = [], []
        for p in ps:
            if cur and p[0] - cur[-1][0] > 1_200_000_000:
                pieces.append(cur)
                cur = []
            cur.append(p)
        for piece in [*pieces, cur] if cur else pieces:
            stops, i = [], 0
            while i < len(piece):
                j = i
                while j + 1 < len(piece) and far(piece[i], piece[j + 1]) <= 50:
                    j += 1
                if piece[j][0] - piece[i][0] >= 300_000_000:
                    stops.append((i, j))
                    i = j + 1
                else:
                    i += 1
            for i, j in stops:
                out.add((v, "stop", piece[i][0] // 1_000_000, piece[j][0] // 1_000_000))
            marks = [(0, 0)] * (not stops or stops[0][0] > 0) + stops + [(len(piece) - 1,) * 2] * (not stops or stops[-1][1] < len(piece) - 1)
            for (_, a), (b, _) in zip(marks, marks[1:]):
                if sum(far(piece[k], piece[k + 1]) for k in range(a, b)) >= 500:
                    out.add((v, "trip", piece[a][0] // 1_000_000, piece[b][0] // 1_000_000))
    return out


def decoded(df, how=Track()):
    return {(r.vehicle_id, r.kind, r.start_s, r.end_s) for r in stops_and_trips(df, how).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_plain_walk(spark, sf):
    path = f"/root/testdata/{sf}/vehicle_positions.parquet"
    cols = ["deliveryId", "receivedAt", "vehicleId", "latitude", "longitude", "timestamp"]
    rows = list(zip(*(pq.read_table(path, columns=cols)[c].to_pylist() for c in cols)))
    assert decoded(spark.read.parquet(path)) == plain(rows)


def parked(days=3, every=600):
    """One vehicle that stands, with noise, over midnights, drives on, and stands again."""
    t, rows, lat = datetime(2026, 8, 3, 20), [], 33.7
    for k in range(days * 86_400 // every):
        lat += 0.004 if 100 < k < 130 else 0
        rows.append((k + 1, t, " bus-1" if k % 2 else "BUS-1 ", lat + (k % 3) * 1e-4, -84.4, t))
        t += timedelta(seconds=every)
    return rows


def test_stop_over_midnight_and_copies(spark):
    rows = parked()
    rows += [(10_000 + r[0], r[1] + timedelta(seconds=5), *r[2:]) for r in rows]  # every ping delivered twice
    got = decoded(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows)
    assert sum(k == "stop" for _, k, _, _ in got) >= 2 and sum(k == "trip" for _, k, _, _ in got) == 1


def test_weighed_path_keeps_clear_stops(spark):
    rows = parked()
    assert {r for r in decoded(spark.createDataFrame(rows, SCHEMA), WEIGHED) if r[1] == "stop"}


def test_weighed_stop_may_end_before_the_radius(spark):
    """Pings that already move off, within the radius, are on the way rather than a part of the stop."""
    t0, lats = datetime(2026, 8, 3, 10), [33.7] * 11 + [33.7 + 45 / 111_195] * 3 + [33.7 + 0.005 * k for k in range(1, 6)]
    rows = [(k, t, "A", lat, -84.4, t) for k, lat in enumerate(lats) for t in [t0 + timedelta(seconds=60 * k)]]
    df, start = spark.createDataFrame(rows, SCHEMA), (t0 - datetime(1970, 1, 1)) // timedelta(seconds=1)
    stops = lambda *how: {r for r in decoded(df, *how) if r[1] == "stop"}
    assert stops(WEIGHED) == {("A", "stop", start, start + 600)}
    assert stops() == {("A", "stop", start, start + 780)}


def test_empty_nulls_and_extra_columns(spark):
    assert decoded(spark.createDataFrame([], SCHEMA)) == set()
    t = datetime(2026, 8, 3)
    rows = [(1, t, None, 33.5, -84.0, t), (2, t, "A", None, None, t), (3, t, "A", float("nan"), -84.0, t), (4, None, "A", 33.5, -84.0, t), (5, t, "A", 33.5, -84.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as day", "2 as t", "'x' as vehicle", "0 as gap", "'' as kind")
    assert decoded(df) == set()


def walk(rng, n, move=0.25):
    t = np.cumsum(rng.integers(40, 200, n)) * 1_000_000
    lat, lon, at, going = np.empty(n), np.empty(n), np.array([33.7, -84.4]), False
    for k in range(n):
        going ^= rng.random() < move
        at = at + (rng.normal(0, 1e-3, 2) if going else 0)
        lat[k], lon[k] = at + rng.normal(0, 1.2e-4, 2)
    return t, lat, lon, np.concatenate([[0.0], metres(lat[1:], lon[1:], lat[:-1], lon[:-1])])


def path_score(stops, t, lat, lon, d, how):
    """Log odds of a path against travel throughout, segment by segment."""
    total, at, starts = 0.0, None, {i for i in range(len(t)) if t[run_end(lat, lon, i, how) - 1] - t[i] >= how.min_stop_s * 1e6}
    for i, e in [*stops, (len(t), None)]:
        total -= how.skip_cost * len(starts & set(range(0 if at is None else at + 1, i)))
        longer = lambda s: log_longer(s / 1e6, how.travel_log_s, how.travel_log_sd)
        if e is None:
            return total + (longer(t[-1] - t[at]) if at is not None and at < len(t) - 1 else 0.0)
        total += longer(t[i] - t[0]) if at is None else float(log_normal((t[i] - t[at]) / 1e6, how.travel_log_s, how.travel_log_sd))
        x, y = (np.radians(lon - lon[i]) * 6_371_008.8 * math.cos(math.radians(lat[0])))[i : e + 1], (np.radians(lat - lat[i]) * 6_371_008.8)[i : e + 1]
        total += float(np.sum(d[i : e + 1] / how.step_m + math.log(how.step_m / how.noise_m) - (x * x + y * y) / (2 * how.noise_m**2)))
        total += float(log_normal((t[e] - t[i]) / 1e6, how.stop_log_s, how.stop_log_sd)) - how.enter_cost - how.leave_cost * (e + 1 < run_end(lat, lon, i, how))
        at = e


def all_paths(t, lat, lon, how, i=0):
    yield []
    for a in range(i, len(t)):
        for e in range(a, run_end(lat, lon, a, how)):
            if t[e] - t[a] >= how.min_stop_s * 1e6:
                for rest in all_paths(t, lat, lon, how, e + 1):
                    yield [(a, e), *rest]


@pytest.mark.parametrize("how", [WEIGHED, Track(skip_cost=2.0, leave_cost=1.0), Track()])
def test_decoder_finds_the_best_of_all_paths(how):
    rng = np.random.default_rng(4)
    for n in (1, 3, 8, 12, 14, 16):
        for _ in range(6):
            track = walk(rng, n)
            best = max(path_score(p, *track, how) for p in all_paths(*track[:3], how))
            assert path_score(decode_track(*track, how), *track, how) == pytest.approx(best)


def test_certain_entry_looks_at_every_ping_once():
    import time

    track = walk(np.random.default_rng(1), 60_000, 0.0)  # one vehicle that never moves
    began = time.time()
    assert sum(e - i + 1 for i, e in decode_track(*track, Track())) > 50_000 and time.time() - began < 2
