"""Declared schemas; input is never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _T = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()


def _struct(fields: str) -> T.StructType:
    kinds = {"s": _S, "d": _D, "i": _I, "t": _T, "S": T.ArrayType(_S), "D": T.ArrayType(_D)}
    return T.StructType([T.StructField(n.rstrip("!"), kinds[k], not n.endswith("!")) for n, k in (f.split(":") for f in fields.split())])


#: A position ping as it is in the log.
PING = _struct("vehicleId!:s routeId!:s tripId:s directionId:i latitude!:d longitude!:d bearingDegrees:d speedMetersPerSecond:d timestamp!:t")
#: A ping snapped to its trip's shape.
PROJECTION = _struct("headwayGroup:s routeShortName:s routeLongName:s directionId:i distanceMetres:d crossTrackMetres:d shapeLengthMetres:d shapeId:s")
#: A window record, in the order of its columns.
RECORD = _struct(
    "windowStart:t windowEnd:t headwayGroup:s routeShortName:s routeLongName:s directionId:i routeLengthMetres:d vehicleCount:i minGapMetres:d "
    "medianGapMetres:d maxGapMetres:d meanGapMetres:d gapsMetres:D orderedVehicles:S orderedDistancesMetres:D layoverVehicles:S "
    "scheduledHeadwaySeconds:i expectedSpacingMetres:d averageSpeedMps:d observedHeadwaySeconds:d headwayRatio:d status:s worstPairVehicles:S"
)
