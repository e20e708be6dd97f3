"""The general data-cleaning operators on small tables with nulls, ties, hot keys and clashing names."""

import datetime as dt
import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tramline.functions.folds import before
from tramline.functions.medians import grouped_median, value_counts
from tramline.operators import anomaly, dedup, late, orphans, quality
from tramline.sources import feed

T0 = dt.datetime(2026, 8, 3, 10)
PING = "deliveryId long, receivedAt timestamp_ntz, vehicleId string, timestamp timestamp_ntz"
DATA = "/root/testdata/sf0.001"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_one_kept_row_per_identifier(spark):
    rows = [
        (1, at(5), " bus-1", at(0)), (2, at(4), "BUS-1 ", at(0.9)), (3, at(4), "Bus-1", at(0.2)),  # one second: 2 came first, by id
        (4, at(9), "BUS-1", at(1)), (5, None, "A", at(1)), (6, at(1), "A", at(1)),
        (7, at(1), None, at(1)), (8, at(2), None, at(1)), (9, at(1), "", at(1)), (10, at(2), " ", at(1)), (11, at(1), "A", None), (12, at(2), "A", None),
    ]
    df = spark.createDataFrame(rows, PING).selectExpr("*", "1 as producer", "2 as block", "3 as lo", "'x' as _row")
    for batches in (1, 2, 3):
        assert {r.delivery_id for r in dedup.repeated_deliveries(df, batches).collect()} == {1, 3, 6, 8, 12}
    assert dedup.repeated_deliveries(df.limit(0)).count() == 0


def test_batches_and_ranges_agree(spark):
    v = spark.read.parquet(f"{DATA}/vehicle_positions.parquet")
    one = {r.delivery_id for r in dedup.repeated_deliveries(v, 1).collect()}
    assert one and one == {r.delivery_id for r in dedup.repeated_deliveries(v, 4).collect()}
    assert sorted(map(tuple, dedup.ping_ranges(v, 1).collect())) == sorted(map(tuple, dedup.ping_ranges(v, 3).collect()))


def test_ranges_against_a_set():
    rng = random.Random(2)
    for span in (5, 40, 400):  # dense to sparse
        r, seen = dedup.Ranges(), set()
        for _ in range(300):
            if rng.random() < 0.1:
                lo = rng.randrange(span)
                hi = lo + rng.randrange(6)
                r.add(lo, hi)
                seen.update(range(lo, hi + 1))
            else:
                x = rng.randrange(span)
                assert r.accept(x) == (x not in seen)
                seen.add(x)
            assert {y for a, b in zip(r.lo, r.hi) for y in range(a, b + 1)} == seen and all(h + 1 < n for h, n in zip(r.hi, r.lo[1:]))


def test_dense_numbers_make_few_ranges(spark):
    """Numbers without gaps, delivered out of order, several times and over a block's edge, in several batches."""
    rng = random.Random(3)
    rows = [(k, at(rng.randrange(5000)), v, at(s)) for k, (v, s) in enumerate((v, s) for v in ("a", "b") for s in range(3400, 7300) for _ in range(rng.choice([1, 1, 3])))]
    df = spark.createDataFrame(rows, PING)
    first = {}
    for d, received, v, t in rows:
        first[v, t] = min(first.get((v, t), (received, d)), (received, d))
    want = {d for d, *_ in rows} - {d for _, d in first.values()}
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    edges = [base + 3400, *range((base + 3400) // 3600 * 3600 + 3600, base + 7300, 3600), base + 7300]
    for batches in (1, 3):
        assert {r.delivery_id for r in dedup.repeated_deliveries(df, batches).collect()} == want
        assert sorted((r.producer, r.lo, r.hi) for r in dedup.ping_ranges(df, batches).collect()) == [(v, a, b - 1) for v in "AB" for a, b in zip(edges[:-1], edges[1:])]


def test_hot_identifier(spark):
    df = spark.range(60_000).select(F.col("id").alias("deliveryId"), F.timestamp_seconds(F.col("id") % 7).cast("timestamp_ntz").alias("receivedAt"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("vehicleId"), F.lit(T0).cast("timestamp_ntz").alias("timestamp"))
    assert dedup.repeated_deliveries(df).count() == 20_000 - 1


KEYS = "k string, loadedAt timestamp_ntz, deletedAt timestamp_ntz, n long"


def test_orphan_states(spark):
    rows = [("a ", at(0), at(10), 1), ("a", at(20), None, 2), ("b", at(50), None, 3), ("c", at(5), at(5), 4), ("d", None, None, 5), (" ", at(0), None, 6), (None, at(0), None, 7), ("e", at(0), at(10), 8), ("e", at(5), at(15), 9), ("e", at(0), at(10), 8)]
    tiles = orphans.existence_tiles(spark.createDataFrame(rows, KEYS), "k")
    asks = [(1, "a", 0), (2, "a", 10), (3, " a", 15), (4, "a", 20), (5, "a", -1), (6, "b", 0), (7, "b", 50), (8, "c", 5), (9, "c", 4), (10, "d", 5), (11, "x", 5), (12, None, 5), (13, " ", 5), (14, "a", None), (15, "e", 12), (16, "e", 15)]
    refs = spark.createDataFrame([(i, k, None if s is None else at(s)) for i, k, s in asks], "id long, ref string, t timestamp_ntz").selectExpr("*", "1 as since", "2 as key", "'s' as state")
    want = {2: "deleted", 3: "deleted", 5: "late", 6: "late", 8: "deleted", 9: "late", 10: "deleted", 11: "missing", 16: "deleted"}
    for most in (1000, 1):  # broadcast, and beyond its bound
        got = orphans.orphans(refs, "r", "id", "ref", "t", tiles, most)
        assert {r.record_id: r.state for r in got.collect()} == want
    assert got.filter("period <> '2026-08-03'").count() == 0
    counts = {r.key: (r.refs, r.existing) for r in orphans.signed_counts(refs, "ref", spark.createDataFrame(rows, KEYS), "k").collect()}
    assert counts["x"] == (1, 0) and counts["e"] == (2, 0) and counts["a"] == (6, 1)
    empty = orphans.existence_tiles(spark.createDataFrame([], KEYS), "k")
    assert {r.state for r in orphans.orphans(refs, "r", "id", "ref", "t", empty).collect()} == {"missing"}


def test_lateness(spark):
    hour = dt.datetime(2026, 8, 3, 11)
    arrivals = {1: 119, 2: 120, 3: 6 * 3600 - 1, 4: 6 * 3600, 5: -7000}
    rows = [(i, at(60), hour + dt.timedelta(seconds=s), float(i)) for i, s in arrivals.items()]
    rows += [(6, hour, hour + dt.timedelta(seconds=3700), 6.0), (7, None, hour, 7.0), (8, hour, None, 8.0), (9, at(60), hour, None), (10, at(61), hour, float("nan"))]
    df = spark.createDataFrame(rows, "id long, e timestamp_ntz, a timestamp_ntz, v double").selectExpr("*", "1 as _event", "'x' as verdict")
    assert {(r.record_id, r.verdict) for r in late.late_rows(df, "s", "id", "e", "a").collect()} == {(2, "corrects"), (3, "corrects"), (4, "dropped")}
    first = {r.period: r for r in late.released(df, "s", "id", "e", "a", "v").collect()}
    ten = first[min(first)]
    assert (ten.provisional_n, ten.final_n, ten.corrects, ten.dropped) == (4, 6, 2, 1)
    assert (ten.provisional_first, ten.provisional_last, ten.final_last) == (1.0, 5.0, 5.0)
    assert late.late_rows(df.limit(0), "s", "id", "e", "a").count() == 0


def test_exact_medians(spark):
    rng = random.Random(1)
    groups = {f"g{k}": [round(rng.choice([rng.random() * 3, rng.expovariate(0.01), 2.5]), 2) for _ in range(rng.choice([1, 2, 9, 400]))] for k in range(12)}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [(None, 1.0)], "g string, x double")
    got = {r.g: (r.m, r.n_) for r in grouped_median(value_counts(df, ["g"], "x"), ["g"], "x", "m", "n_").collect()}
    assert got.pop(None) == (1.0, 1) and got == {g: (median(xs), len(xs)) for g, xs in groups.items()}


def test_ranks_of_one_hot_key(spark):
    rng = random.Random(4)
    xs = [rng.choice([rng.gauss(0, 5), rng.expovariate(0.01), -3.0, 0.0]) for _ in range(3000)]
    df = spark.createDataFrame([("hot", x) for x in xs] + [("few", 1.5), ("none", None)], "k string, x double")
    points = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    want = {c: sorted(xs)[max(0, math.ceil(p * len(xs)) - 1)] for c, p in points.items()}
    got = {r.k: r.asDict() for r in quality.nearest_ranks(df, ["k"], "x", points).collect()}
    assert set(got) == {"hot", "few"} and {c: got["hot"][c] for c in points} == want and got["few"]["p1"] == 1.5
    whole = quality.nearest_ranks(df.filter("k = 'hot'"), [], "x", points).collect()
    assert len(whole) == 1 and {c: whole[0][c] for c in points} == want


def test_rows_before_for_one_key_with_all_rows(spark):
    """Days of one key, ties, nulls and another key, against a plain walk; no task holds more than an hour of a key."""
    rng = random.Random(6)
    rows = [(k, rng.choice(["hot"] * 9 + [None, "b"]), None if rng.random() < 0.01 else at(rng.randrange(200_000)), rng.choice([None, rng.randrange(100)])) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, x int").selectExpr("*", "1 as _own")
    got = {r.id: (r.most, r.last, r.total) for r in before(df.drop("_own"), ["k"], ["t", "id"], max_of={"most": F.col("x")}, lag_of={"last": F.col("x")}, sum_of={"total": F.col("x")}).collect()}
    assert len(got) == len(rows)
    for key in ("hot", None, "b"):
        most, last, total = None, None, None
        for i, _, _, x in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or T0, r[0])):
            total = total if x is None else (total or 0) + x
            assert got[i] == (most, last, total)
            most, last = (most if x is None else x if most is None else max(most, x)), x
    sizes = before(df.drop("_own").filter("k = 'hot'"), ["k"], ["t", "id"], lag_of={"last": F.col("x")}).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.6 * sum(r["count"] for r in sizes)


def test_readings(spark):
    day = lambda h, s=0: int(dt.datetime(2026, 8, 3, tzinfo=dt.timezone.utc).timestamp() + h * 3600 + s) * 1_000_000
    rows, n = [], 0

    def add(source, t, x, src="vehicle_positions"):
        nonlocal n
        n += 1
        rows.append((src, source, n, t, x))
        return n

    for k in range(40):
        add("A", day(1, k * 10), 8.0 + (k % 5) * 0.5)
    far = add("A", day(2), 30.0)
    for x in (float("nan"), -0.1, 60.1, float("inf")):
        add("A", day(2, 10), x)
    odd = {n - 3, n - 2, n - 1, n}
    few = [add("few", day(1, k), 1.0 + k * 0.1) for k in range(20)] + [add("few", day(3), 50.0)]
    stuck = [add("B", day(23, 3570 + k * 10), 5.5) for k in range(8)]  # over midnight: three and five
    add("B", day(30), 0.0)
    zeros = [add("B", day(31, k), 0.0) for k in range(20)]
    seven = [add("C", day(1, k), 4.0) for k in range(7)]
    nobody = add(None, day(1), 99.0)
    cross = add("A", day(1), 20_001.0, "shape_projections")
    fine = add("A", day(1), 19_000.0, "shape_projections")
    df = spark.createDataFrame(rows, "src string, source string, record_id long, t long, x double")
    got = {r.record_id: r for r in anomaly.anomalies(df).collect()}
    assert set(got) == {far, nobody, cross, *odd, *stuck}
    assert got[far].far and all(got[k].stuck for k in stuck) and not {fine, *few, *zeros, *seven} & set(got)
    risk = {r.record_id for r in anomaly.anomalies(df, confirm=False).collect()}
    assert odd < risk and set(stuck) < risk
    assert anomaly.anomalies(df.limit(0)).count() == 0


def test_spikes_against_the_season_of_their_source(spark):
    """A spike below the high season's level is named, plain readings of the high season are not, and another source's season doesn't count."""
    rng, rows = random.Random(5), []

    def add(source, day, hour, x):
        at = dt.datetime(2026, 8, 3 + day, hour, tzinfo=dt.timezone.utc).timestamp()
        rows.append(("vehicle_positions", source, len(rows), int(at * 1e6) + len(rows), x))
        return len(rows) - 1

    high = {"A": range(12, 24), "hot": range(12), "late": range(20, 24)}
    for source, each in (("A", 60), ("hot", 300), ("late", 60)):
        for hour in range(24):
            for _ in range(each):
                add(source, 0, hour, (20.0 if hour in high[source] else 5.0) + min(rng.expovariate(3), 2.0))
    for k in range(48):
        add("thin", k % 5, 6 + 12 * (k % 2), (6.0, 8.0)[k % 2] + k * 0.01)
    spikes = {add("A", 1, 3, 19.0), add("hot", 1, 15, 19.0), add("late", 1, 4, 19.0)}
    df = spark.createDataFrame(rows, "src string, source string, record_id long, t long, x double")
    assert {r.record_id for r in anomaly.anomalies(df, confirm=False).collect()} == spikes
    counts = value_counts(df.withColumn("hour", anomaly.hour_of_day()), ["src", "source", "hour"], "x")
    level = {(r.source, h): x for r in anomaly.levels(counts, anomaly.centres(counts, anomaly.Rules()), anomaly.Rules()).collect() for h, x in enumerate(r.level)}
    assert abs(level["A", 3] - 5.2) < 0.2 and abs(level["A", 15] - 20.2) < 0.2 and abs(level["hot", 3] - 20.2) < 0.2
    m = {s: median(x for _, source, _, _, x in rows if source == s) for s in ("A", "hot", "late", "thin")}
    others = sum(level[s, 18] - m[s] for s in ("A", "hot", "late")) / 3
    assert level["thin", 18] == pytest.approx(m["thin"] + others)  # 24 readings an hour: the season of all sources, one vote each


def varint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def field(k, v):
    import struct

    if isinstance(v, int):
        return varint(k << 3) + varint(v)
    if isinstance(v, float):
        return varint(k << 3 | 5) + struct.pack("<f", v)
    v = v.encode() if isinstance(v, str) else v
    return varint(k << 3 | 2) + varint(len(v)) + v


def vehicle(eid, route="15", where=True, vid="2322", t=1_786_804_260, **position):
    pos = b"".join(field(k, v) for k, v in ((1, 33.79), (2, -84.32), *position.get("more", ())))
    v = (field(1, field(1, "T1") + (field(5, route) if route else b"") + field(6, 5))) + (field(2, pos) if where else b"") + (field(5, t) if t else b"") + (field(8, field(1, vid)) if vid else b"")
    return field(2, field(1, eid) + field(4, v))


def test_feed_messages(spark, tmp_path):
    header = field(1, field(1, "2.0") + field(3, 1_786_804_200))
    message = header + vehicle("e1", more=((3, 90.0), (5, 7.5))) + vehicle("e2", vid=None, t=None) + vehicle("e3", route=None) + vehicle("e4", where=False) + field(2, field(1, "alert only"))
    pings = feed.decode(message)
    assert [(p["vehicleId"], p["timestamp"], p["speedMetersPerSecond"]) for p in pings] == [("2322", 1_786_804_260, 7.5), ("e2", 1_786_804_200, None)]

    class Fake:
        def __init__(self, data):
            self.data = data

        def fetch(self):
            return self.data

    feed.land(Fake(message), str(tmp_path / "in"), "1")
    feed.land(Fake(message[:-7]), str(tmp_path / "in"), "2")
    rows = feed.landed(spark, str(tmp_path / "in")).orderBy("vehicleId").collect()
    assert [(r.vehicleId, r.routeId, r.directionId) for r in rows] == [("2322", "15", 5), ("e2", "15", 5)]
