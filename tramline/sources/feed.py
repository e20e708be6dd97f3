"""Realtime vehicle feeds: landing messages as files, decoding them to pings.

The wire format is protocol buffers. Field numbers below are those of the public GTFS-realtime specification.
"""

from __future__ import annotations

import struct
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Field numbers of the messages that are read (fixed values).
HEADER, ENTITY, HEADER_TIMESTAMP = 1, 2, 3
ENTITY_ID, ENTITY_VEHICLE = 1, 4
V_TRIP, V_POSITION, V_TIMESTAMP, V_DESCRIPTOR = 1, 2, 5, 8
TRIP_ID, TRIP_ROUTE, TRIP_DIRECTION = 1, 5, 6
P_LATITUDE, P_LONGITUDE, P_BEARING, P_SPEED = 1, 2, 3, 5
DESCRIPTOR_ID = 1

PINGS = "vehicleId string, routeId string, tripId string, directionId int, latitude double, longitude double, bearingDegrees double, speedMetersPerSecond double, timestamp timestamp"


class VehicleFeed(Protocol):
    """Where raw feed messages come from, so that replays and fakes can stand in."""

    def fetch(self) -> bytes: ...


class HttpFeed:
    def __init__(self, url: str, timeout: float = 20.0):
        self.url, self.timeout = url, timeout

    def fetch(self) -> bytes:
        """The message's bytes; an answer other than 200 is an OSError."""
        with urllib.request.urlopen(self.url, timeout=self.timeout) as r:
            if r.status != 200:
                raise OSError(f"{self.url} answered {r.status}")
            return r.read()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: varints as int, 32- and 64-bit fields and messages as bytes. Cut-off data is a ValueError."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            if i >= n or shift > 63:
                raise ValueError("broken message")
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = 4 if kind == 5 else 8 if kind == 1 else varint() if kind == 2 else -1
        if size < 0 or i + size > n:
            raise ValueError("broken message")
        yield tag >> 3, data[i : i + size]
        i += size


def decode(message: bytes) -> list[dict]:
    """Pings of a feed message. Entities without vehicle, position or route id are left out; the vehicle id falls
    back to the entity's, the time to the header's. Optional fields that aren't there are None."""
    now, entities = None, []
    for number, value in fields(message):
        if number == HEADER:
            now = dict(fields(value)).get(HEADER_TIMESTAMP)
        elif number == ENTITY:
            entities.append(dict(fields(value)))
    out = []
    for e in entities:
        if ENTITY_VEHICLE not in e:
            continue
        v = dict(fields(e[ENTITY_VEHICLE]))
        if V_POSITION not in v:
            continue
        trip, at, who = (dict(fields(v.get(k, b""))) for k in (V_TRIP, V_POSITION, V_DESCRIPTOR))
        text = lambda m, k: m[k].decode("utf-8", "replace") if m.get(k) else None
        real = lambda k: struct.unpack("<f", at[k])[0] if k in at else None
        route = text(trip, TRIP_ROUTE)
        if not route or P_LATITUDE not in at or P_LONGITUDE not in at:
            continue
        out.append(
            {
                "vehicleId": text(who, DESCRIPTOR_ID) or text(e, ENTITY_ID), "routeId": route, "tripId": text(trip, TRIP_ID), "directionId": trip.get(TRIP_DIRECTION),
                "latitude": real(P_LATITUDE), "longitude": real(P_LONGITUDE), "bearingDegrees": real(P_BEARING), "speedMetersPerSecond": real(P_SPEED), "timestamp": v.get(V_TIMESTAMP) or now,
            }
        )
    return out


def encode(pings: list[dict], header: int | None = None) -> bytes:
    """The feed message of some pings, for replays; None and NaN fields are left out."""

    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes(out) + bytes([x])

    def put(number: int, value) -> bytes:
        if value is None or value != value or value == "":
            return b""
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        data = value.encode() if isinstance(value, str) else value
        return varint(number << 3 | 2) + varint(len(data)) + data

    whole = lambda x: None if x is None or x != x else int(x)
    out = put(HEADER, put(1, "2.0") + put(HEADER_TIMESTAMP, header))
    for p in pings:
        at = b"".join(put(n, None if p[k] is None else float(p[k])) for n, k in ((P_LATITUDE, "latitude"), (P_LONGITUDE, "longitude"), (P_BEARING, "bearingDegrees"), (P_SPEED, "speedMetersPerSecond")))
        trip = put(TRIP_ID, p["tripId"]) + put(TRIP_ROUTE, p["routeId"]) + put(TRIP_DIRECTION, whole(p["directionId"]))
        vehicle = put(V_TRIP, trip) + put(V_POSITION, at) + put(V_TIMESTAMP, whole(p["timestamp"])) + put(V_DESCRIPTOR, put(DESCRIPTOR_ID, p["vehicleId"]))
        out += put(ENTITY, put(ENTITY_ID, p["vehicleId"]) + put(ENTITY_VEHICLE, vehicle))
    return out


def land(feed: VehicleFeed, folder: str, name: str) -> str:
    """Fetch once and put the message where the readers of `landed` look, in one move."""
    import os

    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}.part")
    with open(part, "wb") as f:
        f.write(feed.fetch())
    os.replace(part, to := os.path.join(folder, f"{name}.pb"))
    return to


def _decode_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for content in f["content"]:
            try:
                rows += decode(bytes(content))
            except (ValueError, struct.error):
                continue  # a message cut off in transit has no pings
        d = pd.DataFrame(rows, columns=[c.split()[0] for c in PINGS.split(", ")])
        d["timestamp"] = pd.to_datetime(d["timestamp"], unit="s", utc=True)
        yield d.astype({"directionId": "Int32"})


def landed(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Pings of the landed messages of a folder."""
    if stream:
        raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pb").load(folder)
    else:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pb").load(folder)
    return raw.select("content").mapInPandas(_decode_frames, PINGS)
