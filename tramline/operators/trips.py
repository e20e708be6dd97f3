"""Stops and trips from location pings: hidden semi-Markov decoding with explicit durations.

A track alternates between two states. A stop is a segment whose pings all lie within `radius_m` of its first
one, scattered around it as a Gaussian of `noise_m`; it lasts at least `min_stop_s`, with log-normal durations from
there. Travel is a segment between stops, with exponential step lengths and log-normal durations of its own; at the
edges of a track, where it began earlier or goes on, the chance of lasting at least as long counts. `decode_track` finds
the best sequence of segments over all starts and durations, scoring stops by prefix sums.

Two odds link the states: passing a ping that could begin a stop costs `skip_cost`, ending a stop while the next
ping is still within its radius costs `leave_cost`. `Track()` has both beyond anything that the densities can weigh up: a stop
is entered with certainty at the first ping that can begin one, and left where its radius ends, which is the path
that TESTDATA fixes. `WEIGHED` has odds at which durations and positions decide. Gaps longer than `gap_s` split
tracks before anything else.

How it is spread: pings are first grouped by (vehicle, UTC day) with two hours of the neighbouring days
around (no speed limit can be broken across a longer pause inside the box of positions), which settles
outliers, steps and gaps. A stop can't hold two successive pings more than 2 * radius_m apart, so every
longer step is a point at which any track can be cut; days are handed on to workers as the pieces between
such points. What comes back is a few events a piece, and trips are summed over those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.ids import floor_div
from tramline.operators.anomaly import sound_pings

SECOND = 1_000_000
DAY = 86_400 * SECOND
EARTH_M = 6_371_008.8


@dataclass(frozen=True)
class Track:
    south: float = 33.0
    north: float = 35.0
    west: float = -86.0
    east: float = -83.0
    top_speed: float = 60.0
    gap_s: float = 1200.0
    radius_m: float = 50.0
    min_stop_s: float = 300.0
    min_trip_m: float = 500.0
    noise_m: float = 15.0
    step_m: float = 150.0
    stop_log_s: float = 6.5
    stop_log_sd: float = 1.0
    travel_log_s: float = 7.0
    travel_log_sd: float = 1.2
    enter_cost: float = 3.0
    skip_cost: float = 1e9
    leave_cost: float = 1e9

    def halo_s(self) -> float:
        """Pings this far around a day settle it: a gap, and the longest time in which the box's diagonal breaks the speed limit."""
        diagonal = EARTH_M * math.hypot(math.radians(self.north - self.south), math.radians(self.east - self.west))
        return self.gap_s + diagonal / self.top_speed


#: Odds at which durations and positions decide.
WEIGHED = Track(skip_cost=0.0, leave_cost=0.0)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def steps(pings: DataFrame, how: Track) -> DataFrame:
    """(vehicle, day, t, lat, lon, d, gap, cut) of every ping that stays: d metres from the one before,
    gap where a track begins, cut where no stop can hold both."""
    halo = int(how.halo_s() * SECOND) + SECOND
    inside = sound_pings(pings, "latitude", "longitude").filter(
        F.col("vehicle").isNotNull() & F.col("latitude").between(how.south, how.north) & F.col("longitude").between(how.west, how.east)
    )
    spread = inside.select(
        "vehicle",
        F.explode(F.sequence(floor_div(F.col("_t") - halo, DAY), floor_div(F.col("_t") + halo, DAY))).alias("day"),
        F.col("_t").alias("t"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
    )
    w = Window.partitionBy("vehicle", "day").orderBy("t")

    def pace(k: int) -> Column:
        lat, lon, t = (F.lag(c, k).over(w) for c in ("lat", "lon", "t"))
        # too fast if the distance is more than the limit allows in the time between
        return F.coalesce(great_circle(F.col("lat"), F.col("lon"), lat, lon) > how.top_speed * F.abs(F.col("t") - t) / SECOND, F.lit(False))

    stay = spread.withColumn("_wild", pace(1) & pace(-1)).filter("not _wild")
    d = great_circle(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    gap = F.coalesce(F.col("t") - F.lag("t").over(w) > how.gap_s * SECOND, F.lit(True))
    own = stay.withColumns({"d": d, "gap": gap}).filter(floor_div(F.col("t"), DAY) == F.col("day"))
    return own.select("vehicle", "day", "t", "lat", "lon", F.when(~F.col("gap"), F.col("d")).otherwise(0.0).alias("d"), "gap", (F.col("gap") | (F.col("d") > 2 * how.radius_m + 1)).alias("cut"))


def pieces(stepped: DataFrame) -> DataFrame:
    """stepped with `piece`: the day of the last cut at or before the ping, so that a piece begins at a cut."""
    firsts = stepped.groupBy("vehicle", "day").agg(F.min(F.when(F.col("cut"), F.col("t"))).alias("_first"))
    w = Window.partitionBy("vehicle").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.withColumn("_carry", F.last(F.when(F.col("_first").isNotNull(), F.col("day")), ignorenulls=True).over(w))
    piece = F.when(F.col("t") >= F.col("_first"), F.col("day")).otherwise(F.col("_carry"))
    return stepped.join(carried, ["vehicle", "day"]).withColumn("piece", piece).drop("_first", "_carry", "day")


def metres(lat: np.ndarray, lon: np.ndarray, lat0, lon0) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lat0)
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(lon) - np.radians(lon0)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def run_end(lat: np.ndarray, lon: np.ndarray, i: int, how: Track) -> int:
    """One past the last ping of the longest run from i within the radius of i."""
    lo, size, stop = i + 1, 32, len(lat)
    while lo < stop:
        hi = min(stop, lo + size)
        out = np.flatnonzero(metres(lat[lo:hi], lon[lo:hi], lat[i], lon[i]) > how.radius_m)
        if len(out):
            return lo + int(out[0])
        lo, size = hi, size * 4
    return stop


def log_normal(s: np.ndarray, mean: float, sd: float) -> np.ndarray:
    return -0.5 * ((np.log(s) - mean) / sd) ** 2 - np.log(s * sd) - 0.5 * math.log(2 * math.pi)


def log_longer(s: float, mean: float, sd: float) -> float:
    """Log chance of a log-normal duration of at least s seconds."""
    return math.log(max(1e-300, 0.5 * math.erfc((math.log(max(s, 1e-9)) - mean) / (sd * math.sqrt(2)))))


def decode_track(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, d: np.ndarray, how: Track) -> list[tuple[int, int]]:
    """The stops, as (first, last) positions in order, of the best path through the pings of one track.

    Scores are log odds against a track that is travel throughout. A hypothesis is the end of a stop with the best
    path to it. One goes when even the most that it can still gain leaves it below what another is sure of, so that
    only paths that can't be the best go. With certain entry one hypothesis is left at a time, and every
    ping is looked at once.
    """
    n, least = len(t), int(how.min_stop_s * SECOND)
    if not n or t[-1] - t[0] < least:
        return []
    long = np.searchsorted(t, t + least)  # the first ping that a stop from here must reach
    starts = np.flatnonzero(long < n)
    starts = starts[metres(lat[starts], lon[starts], lat[long[starts]], lon[long[starts]]) <= how.radius_m]
    if not len(starts):
        return []
    x = np.radians(lon - lon[0]) * EARTH_M * math.cos(math.radians(float(lat[0])))
    y = np.radians(lat - lat[0]) * EARTH_M
    upto = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    sx, sy, sq = upto(x), upto(y), upto(x * x + y * y)
    gain = upto(np.maximum(0.0, d / how.step_m + math.log(how.step_m / how.noise_m)))  # at most, of a stop's pings over travelled ones
    exact = upto(d / how.step_m + math.log(how.step_m / how.noise_m))
    density = max(0.0, -math.log(min(how.stop_log_sd, how.travel_log_sd)) - how.stop_log_s + how.stop_log_sd**2)  # more than any duration's
    count = np.arange(n + 1)
    surely = -700.0  # log_longer is never below it
    # by the end of the last stop, plus 1; 0 is the beginning of the track
    score, first, before = np.full(n + 1, -np.inf), np.full(n + 1, -1), np.zeros(n + 1, int)
    score[0] = 0.0
    lo = 0  # no hypothesis is before it
    for i in starts.tolist():
        on = np.flatnonzero(score[lo : i + 1] > -np.inf) + lo
        if not len(on):
            continue  # every path that is left stands still here
        stop = run_end(lat, lon, i, how)
        if long[i] >= stop:
            continue
        last = on[1:] if on[0] == 0 else on
        came = score[last] + log_normal((t[i] - t[last - 1]) / SECOND, how.travel_log_s, how.travel_log_sd)
        k = int(np.argmax(came)) if len(last) else -1
        best, via = (float(came[k]), int(last[k])) if k >= 0 else (-math.inf, 0)
        if on[0] == 0 and (from_start := float(score[0]) + log_longer((t[i] - t[0]) / SECOND, how.travel_log_s, how.travel_log_sd)) >= best:
            best, via = from_start, 0
        # the ends that i admits lie together: long[i] .. stop - 1
        e0 = int(long[i])
        ends, nexts = slice(e0, stop), slice(e0 + 1, stop + 1)
        away = (sq[nexts] - sq[i]) - 2 * (x[i] * (sx[nexts] - sx[i]) + y[i] * (sy[nexts] - sy[i])) + count[e0 - i + 1 : stop - i + 1] * (x[i] ** 2 + y[i] ** 2)
        total = exact[nexts] - away / (2 * how.noise_m**2) + log_normal((t[ends] - t[i]) / SECOND, how.stop_log_s, how.stop_log_sd) + (best - how.enter_cost - exact[i])
        if how.leave_cost:
            total[:-1] -= how.leave_cost
        if how.skip_cost:
            score[on] -= how.skip_cost  # what travels on has passed a start
        sure = float(total.max()) + surely
        score[on[score[on] + (gain[n] - gain[i] + density) < sure]] = -np.inf
        better = np.flatnonzero((total > score[nexts]) & (total + (gain[n] + density) - gain[nexts] >= sure))
        at = better + (e0 + 1)
        score[at], first[at], before[at] = total[better], i, via
        while lo < n and score[lo] == -np.inf:
            lo += 1
    left = np.flatnonzero(score > -np.inf)
    last = np.array([log_longer((t[-1] - t[e - 1]) / SECOND, how.travel_log_s, how.travel_log_sd) if 0 < e < n else 0.0 for e in left.tolist()])
    e, out = int(left[np.argmax(score[left] + last)]), []
    while e:
        out.append((int(first[e]), e - 1))
        e = int(before[e])
    return out[::-1]


def stops_of(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, d: np.ndarray, gaps: np.ndarray, how: Track) -> list[tuple[int, int]]:
    """Stops as (first, last) positions, in order, of pings in order of time; gaps: positions where tracks begin."""
    edges = sorted({0, *gaps.tolist(), len(t)})
    return [(a + i, a + e) for a, b in zip(edges[:-1], edges[1:], strict=True) for i, e in decode_track(t[a:b], lat[a:b], lon[a:b], d[a:b], how)]


def piece_events(key: tuple, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, d: np.ndarray, gap: np.ndarray, how: Track) -> dict:
    """Events of one piece in order: track begins (B), stop (S), rest of the piece (E); metres: the way since the event before."""
    way = np.cumsum(d)
    rows: list[tuple[str, int, int, float]] = []
    begins = np.flatnonzero(gap)
    stops = stops_of(t, lat, lon, d, begins, how)
    marks = sorted([(int(i), 0, int(i)) for i in begins] + [(s, 1, e) for s, e in stops])
    at = float(way[0] - d[0])  # the way at the event before
    for n, (i, kind, e) in enumerate(marks):
        if kind == 0:
            if i:
                rows.append(("E", int(t[i - 1]), int(t[i - 1]), float(way[i - 1]) - at))
            rows.append(("B", int(t[i]), int(t[i]), 0.0))
            at = float(way[i])
        else:
            rows.append(("S", int(t[i]), int(t[e]), float(way[i]) - at))
            at = float(way[e])
    rows.append(("E", int(t[-1]), int(t[-1]), float(way[-1]) - at))
    return {"vehicle": [key[0]] * len(rows), "n": list(range(len(rows))), "piece": [key[1]] * len(rows), "kind": [r[0] for r in rows], "t0": [r[1] for r in rows], "t1": [r[2] for r in rows], "metres": [r[3] for r in rows]}


EVENTS = pa.schema([("vehicle", pa.string()), ("n", pa.int64()), ("piece", pa.int64()), ("kind", pa.string()), ("t0", pa.int64()), ("t1", pa.int64()), ("metres", pa.float64())])
EVENTS_SQL = "vehicle string, n long, piece long, kind string, t0 long, t1 long, metres double"


def decode(how: Track):
    """Arrow batches of sorted (vehicle, piece, t, ...) to events. One piece is held at a time: at most one ping a second, for as long as the vehicle makes no step of 2 * radius_m."""

    def flush(parts: list[pa.RecordBatch], out: list[dict]) -> None:
        b = pa.Table.from_batches(parts).combine_chunks()
        vehicle, piece = b["vehicle"].to_numpy(), b["piece"].to_numpy()
        t, lat, lon, d = (b[c].to_numpy() for c in ("t", "lat", "lon", "d"))
        gap = b["gap"].to_numpy()
        edges = np.flatnonzero((vehicle[1:] != vehicle[:-1]) | (piece[1:] != piece[:-1])) + 1
        edges = np.concatenate([[0], edges, [len(t)]])
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            s = slice(int(x), int(y))
            out.append(piece_events((vehicle[x], int(piece[x])), t[s], lat[s], lon[s], d[s], gap[s], how))

    def batch_of(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: [v for o in out for v in o[f.name]] for f in EVENTS}, schema=EVENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            v, p = b.column("vehicle"), b.column("piece")
            last = (v[b.num_rows - 1], p[b.num_rows - 1])
            # the rows of the batch's last piece wait for the next batch
            vn, pn = v.to_numpy(zero_copy_only=False), p.to_numpy()
            other = np.flatnonzero((vn != last[0].as_py()) | (pn != last[1].as_py()))
            k = int(other[-1]) + 1 if len(other) else 0
            if k == 0 and held and not (held[-1].column("vehicle")[-1].as_py() == last[0].as_py() and held[-1].column("piece")[-1].as_py() == last[1].as_py()):
                out: list[dict] = []
                flush(held, out)
                held = []
                yield batch_of(out)
            elif k:
                out = []
                flush([*held, b.slice(0, k)], out)
                held = []
                yield batch_of(out)
            held.append(b.slice(k))
        if held:
            out = []
            flush(held, out)
            yield batch_of(out)

    return run


def events(pings: DataFrame, how: Track = Track()) -> DataFrame:
    cut_up = pieces(steps(pings, how)).select("vehicle", "piece", "t", "lat", "lon", "d", "gap")
    return cut_up.repartition("vehicle", "piece").sortWithinPartitions("vehicle", "piece", "t").mapInArrow(decode(how), EVENTS_SQL)


def stops_and_trips(pings: DataFrame, how: Track = Track()) -> DataFrame:
    """(vehicle_id, kind, start_s, end_s, metres) of every stop and trip; a stop's metres are 0.

    Rows without vehicle, time or a position in the box are left out; repeated deliveries count once. Pings
    of one vehicle at one moment can't be (identifiers are whole seconds). No pings, no rows. Events are at
    most one per min_stop_s or gap_s and day of a vehicle, which bounds what the last sum orders per vehicle.
    """
    e = events(pings, how)
    w = Window.partitionBy("vehicle").orderBy("piece", "n")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("kind").isin("S", "B"), 1).otherwise(0)
    told = e.withColumns({"_leg": F.coalesce(F.sum(opens).over(before), F.lit(0)), "_own": F.sum(opens).over(upto)})
    none = F.lit(None).cast("long")
    part = lambda what, leg, start, stop, rest, m: F.struct(F.lit(what).alias("kind"), leg.alias("leg"), start.alias("start"), stop.alias("stop"), rest.alias("rest"), m.alias("metres"))
    at = lambda kinds, c: F.when(F.col("kind").isin(*kinds), F.col(c))
    # every event ends or extends the leg before it; S and B also open a leg; S is a stop as well
    parts = F.array(
        part("trip", F.col("_leg"), none, at("S", "t0"), at("E", "t1"), F.col("metres")),
        part("trip", F.col("_own"), at("SB", "t1"), none, none, F.lit(0.0)),
        F.when(F.col("kind") == "S", part("stop", F.col("_own"), F.col("t0"), F.col("t1"), none, F.lit(0.0))),
    )
    cut_s = lambda c: floor_div(F.col(c), SECOND)
    return (
        told.select("vehicle", F.explode(F.array_compact(parts)).alias("x"))
        .select("vehicle", "x.*")
        .groupBy("vehicle", "kind", "leg")
        .agg(F.max("start").alias("start"), F.coalesce(F.min("stop"), F.max("rest")).alias("end"), F.sum("metres").alias("metres"))
        .filter(((F.col("kind") == "stop") | (F.col("metres") >= how.min_trip_m)) & F.col("start").isNotNull() & F.col("end").isNotNull())
        .select(F.col("vehicle").alias("vehicle_id"), "kind", cut_s("start").alias("start_s"), cut_s("end").alias("end_s"), "metres")
    )
