"""Geometry of positions and polylines, as column expressions.

A polyline is array<struct<seq, lat, lon, m>> in order, m being metres from its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.config import CONFIG


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, by atan2."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * CONFIG.earth_m) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def segments(pts: Column) -> Column:
    """The polyline's segments (k, lat, lon, m, lat2, lon2, m2), k from 0; none for fewer than two points."""
    n = F.size(pts)
    pair = F.zip_with(F.slice(pts, 1, F.greatest(n - 1, F.lit(0))), F.slice(pts, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(
        pair,
        lambda p, k: F.struct(
            k.alias("k"), p["a"]["lat"].alias("lat"), p["a"]["lon"].alias("lon"), p["a"]["m"].alias("m"), p["b"]["lat"].alias("lat2"), p["b"]["lon"].alias("lon2"), p["b"]["m"].alias("m2")
        ),
    )
