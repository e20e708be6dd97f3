"""Pings snapped to the nearest segment of their shape, by vectors instead of one lambda call per segment.

A batch of pings meets each of its shapes as one matrix. Shapes are a static table: up to MAX_POINTS points in all (counted
first) they are sent to the workers as arrays. Beyond that every shape's points go, once, before each part of its pings, in
a shuffle by (shape, part); a shape with many pings has many parts. Both ways give the same by the same code.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.config import CONFIG

MAX_POINTS = 2_000_000
#: Pings of a shape that one part has on average, if shapes aren't sent to all workers.
PART_ROWS = 200_000
CELLS = 1 << 20  # of a matrix of pings and segments
_FIELDS = [("distanceAlongRouteMetres", T.DoubleType()), ("crossTrackMetres", T.DoubleType()), ("segmentIndex", T.IntegerType()), ("snappedLatitude", T.DoubleType()), ("snappedLongitude", T.DoubleType())]


def nearest_of(pts: np.ndarray, lat: np.ndarray, lon: np.ndarray, hint: np.ndarray | None = None, window: float = 0.0) -> list[np.ndarray]:
    """Of every position: along, cross-track, segment, snapped latitude and longitude. pts: rows of lat, lon, m.

    hint: metres along; only segments that meet hint +- window count, the first one if that lies before the start, all if it
    lies beyond the end or the hint is NaN. Distances are told apart to the square millimetre; of equal ones the first segment counts.
    """
    a, b = pts[:-1], pts[1:]
    per = CONFIG.metres_per_degree
    out = [np.empty(len(lat)) for _ in range(5)]
    step = max(1, CELLS // len(a))
    for i in range(0, len(lat), step):
        y, x = lat[i : i + step, None], lon[i : i + step, None]
        cos = np.cos(np.radians(y))
        ax, ay = (a[:, 1] - x) * cos * per, (a[:, 0] - y) * per
        dx, dy = (b[:, 1] - a[:, 1]) * cos * per, np.broadcast_to((b[:, 0] - a[:, 0]) * per, ax.shape)
        size = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(size == 0, 0.0, np.clip(-(ax * dx + ay * dy) / size, 0.0, 1.0))
        d2 = (ax + t * dx) ** 2 + (ay + t * dy) ** 2
        if hint is not None:
            h = hint[i : i + step, None]
            met = (b[:, 2] >= h - window) & (a[:, 2] <= h + window)
            early = (h + window < a[0, 2])[:, 0]
            met[~met.any(axis=1) & ~early] = True  # beyond the end, or without a hint
            met[early] = np.arange(len(a)) == 0
            d2 = np.where(met, d2, np.inf)
        k = np.argmin(np.round(d2, 6), axis=1)
        r = np.arange(len(k))
        tk = t[r, k]
        for o, v in zip(out, (a[k, 2] + tk * (b[k, 2] - a[k, 2]), np.sqrt(d2[r, k]), k, a[k, 0] + tk * (b[k, 0] - a[k, 0]), a[k, 1] + tk * (b[k, 1] - a[k, 1])), strict=True):
            o[i : i + step] = v
    return out


def flat(lines: DataFrame) -> DataFrame:
    """(shapeId, _lat, _lon, _m): the points of polylines as arrays of numbers."""
    last = F.element_at("segments", -1)
    one = lambda c: F.concat(F.transform("segments", lambda s: s[c]), F.array(last[c + "2"]))
    return lines.select("shapeId", *[one(c).alias(f"_{c}") for c in ("lat", "lon", "m")])


def _points(b: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
    return np.stack([np.asarray(b.column(c)[k].values) for c in ("_lat", "_lon", "_m")], 1)


def _columns(b: pa.RecordBatch, got: list[np.ndarray], known: np.ndarray) -> list[pa.Array]:
    """The batch's new columns; null where a ping's place isn't known."""
    return [pa.array(np.where(known, g, 0).astype(np.int32 if isinstance(t, T.IntegerType) else float), mask=~known) for g, (_, t) in zip(got, _FIELDS, strict=True)]


def _placed(b: pa.RecordBatch, at: tuple, lines: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Nearest places of the rows of a batch, and which rows have one."""
    lat, lon, shape, hint, window = at
    coded = b.column(shape).dictionary_encode()
    code, names = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    y, x, h = (None if c is None else b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (lat, lon, hint))
    got, known = [np.zeros(b.num_rows) for _ in _FIELDS], np.zeros(b.num_rows, bool)
    fine = ~np.isnan(y) & ~np.isnan(x)
    for k, n in enumerate(names):
        if n in lines:
            own = np.flatnonzero((code == k) & fine)
            known[own] = True
            for g, v in zip(got, nearest_of(lines[n], y[own], x[own], None if h is None else h[own], window), strict=True):
                g[own] = v
    return got, known


def _snap(shared, at: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[str, np.ndarray] = pickle.loads(shared.value)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *_columns(b, *_placed(b, at, lines))], names=[*b.schema.names, *[n for n, _ in _FIELDS]])

    return run


def _snap_parts(at: tuple, columns: list[str]):
    """Arrow batches in which a shape's points come before its pings; one shape is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            first = np.flatnonzero(b.column("_tag").to_numpy() == 0)
            edges = [0, *first.tolist(), b.num_rows]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(x, y - x)
                if part.num_rows and part.column("_tag")[0].as_py() == 0:
                    held = {part.column("_shape")[0].as_py(): _points(part, 0)}
                    part = part.slice(1)
                if part.num_rows:
                    own = pa.RecordBatch.from_arrays([part.column(c) for c in columns], names=columns)
                    yield pa.RecordBatch.from_arrays([*own.columns, *_columns(own, *_placed(own, at, held))], names=[*columns, *[n for n, _ in _FIELDS]])

    return run


def snap(pings: DataFrame, lines: DataFrame, shape: str = "tripShape", lat: str = "latitude", lon: str = "longitude", max_points: int = MAX_POINTS, hint: str | None = None, window: float = CONFIG.hint_window_m) -> DataFrame:
    """pings with distanceAlongRouteMetres, crossTrackMetres, segmentIndex, snappedLatitude and snappedLongitude; null for
    pings without position (null or NaN) or whose shape isn't in `lines` (shapeId, pts, pointCount). Equal distances go to the first segment.

    hint: a column with metres along the shape; the search is then held to the segments that meet it, `window` metres to either side.
    """
    at = (lat, lon, shape, hint, window)
    out = T.StructType([*pings.schema.fields, *[T.StructField(n, t) for n, t in _FIELDS]])
    total = lines.agg(F.sum("pointCount")).first()[0] or 0
    if total <= max_points:
        b = flat(lines).toArrow()
        arrays = {n: _points(b, k) for k, n in enumerate(b.column("shapeId").to_pylist())}
        shared = pings.sparkSession.sparkContext.broadcast(pickle.dumps(arrays))
        return pings.mapInArrow(_snap(shared, at), out)
    parts = pings.groupBy(F.col(shape).alias("_shape")).agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    salted = pings.withColumn("_shape", F.col(shape)).join(parts.withColumnRenamed("_shape", "_s"), F.col("_shape").eqNullSafe(F.col("_s")))
    own = F.xxhash64(*[f.name for f in pings.schema.fields if not isinstance(f.dataType, T.MapType)])  # the same if a task runs again
    rows = salted.withColumns({"_part": F.pmod(own, F.col("_parts")), "_tag": F.lit(1)}).drop("_s", "_parts")
    points = flat(lines).withColumnRenamed("shapeId", "_shape").join(parts, "_shape").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).withColumn("_tag", F.lit(0)).drop("_parts")
    both = rows.unionByName(points, allowMissingColumns=True)
    return both.repartition("_shape", "_part").sortWithinPartitions("_shape", "_part", "_tag").mapInArrow(_snap_parts(at, pings.columns), out)
