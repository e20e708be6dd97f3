"""References to records that do not exist, by signed existence and reference counts per key.

Every row of the referred table is two change deltas of its key's existence: +1 when it is loaded, -1 when
it is deleted. Their running sum gives, for each key, the stretches of time in which it exists. Those
stretches tile the whole time axis of a key, so that every reference meets exactly one tile, whose state it
takes; a reference that meets none has a key that never existed. References are +1 deltas of their key;
their sum over a key of the tile's state is the orphan report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.ids import bare, micros
from tramline.session import small_side

#: Far before and after every time (fixed values).
FIRST, LAST = -(2**62), 2**62
#: Tiles that may be broadcast: about 100 bytes each.
MAX_BROADCAST_TILES = 200_000


def existence_tiles(rows: DataFrame, key: str, loaded: str = "loadedAt", deleted: str = "deletedAt") -> DataFrame:
    """(key, since, until, state) with since <= t < until; state is live, late or deleted.

    Null or blank keys are no keys. A row without a loading time was never loaded: it makes its key known
    but adds no existence. A row deleted at or before its loading never exists. Repeated rows just count
    twice. A key's deltas at one moment are summed before the sum runs, so a hot key costs one row per moment.
    """
    k = bare(key)
    known = rows.filter(k != "").select(k.alias("key"), micros(loaded).alias("on"), micros(deleted).alias("off"))
    real = F.col("on").isNotNull() & (F.col("off").isNull() | (F.col("off") > F.col("on")))
    deltas = known.select(
        "key",
        F.explode(
            F.array(
                F.struct(F.lit(FIRST).cast("long").alias("at"), F.lit(0).alias("delta"), F.lit(0).alias("loads")),
                F.struct(F.coalesce("on", F.lit(FIRST)).alias("at"), F.when(real, 1).otherwise(0).alias("delta"), F.col("on").isNotNull().cast("int").alias("loads")),
                F.struct(F.when(real, F.col("off")).alias("at"), F.lit(-1).alias("delta"), F.lit(0).alias("loads")),
            )
        ).alias("d"),
    ).select("key", "d.*")
    moments = deltas.filter("at is not null").groupBy("key", "at").agg(F.sum("delta").alias("delta"), F.max("loads").alias("loads"))
    w = Window.partitionBy("key").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.sum("delta").over(upto) > 0, "live").when(F.max("loads").over(upto) == 0, "late").otherwise("deleted")
    never = F.max("loads").over(Window.partitionBy("key")) == 0
    return moments.select(
        "key", F.col("at").alias("since"), F.coalesce(F.lead("at").over(w), F.lit(LAST)).alias("until"), F.when(never, "deleted").otherwise(state).alias("state")
    )


def orphans(refs: DataFrame, src: str, record: str, key: str, at: str, tiles: DataFrame, max_broadcast: int = MAX_BROADCAST_TILES) -> DataFrame:
    """(src, record_id, period, state, key) of every row of `refs` whose key doesn't exist at its time.

    Null and blank keys are no references; rows without a time can't be placed and are left out. Tiles are
    broadcast only if counted to be at most max_broadcast; else both sides are shuffled by key and the
    adaptive skew join splits a hot key, whose tiles are few.
    """
    t, k = micros(at), bare(key)
    r = refs.filter((k != "") & t.isNotNull()).select(F.col(record).alias("record_id"), k.alias("key"), t.alias("_t"))
    s = small_side(tiles.withColumnRenamed("key", "_key"), max_broadcast)
    met = r.join(s, (r["key"] == s["_key"]) & (r["_t"] >= s["since"]) & (r["_t"] < s["until"]), "left")
    return met.filter(F.col("state").isNull() | (F.col("state") != "live")).select(
        F.lit(src).alias("src"),
        "record_id",
        F.date_format(F.timestamp_micros("_t"), "yyyy-MM-dd").alias("period"),
        F.coalesce("state", F.lit("missing")).alias("state"),
        "key",
    )


def transit_orphans(pings: DataFrame, trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Orphan references of pings to trips and of trips to shapes."""
    return orphans(pings, "vehicle_positions", "deliveryId", "tripId", "timestamp", existence_tiles(trips, "tripId")).unionByName(
        orphans(trips, "gtfs_trips", "feedRow", "shapeId", "loadedAt", existence_tiles(shapes, "shapeId"))
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Signed reference counts of keys without existence, per table, period and state."""
    per_key = found.groupBy("src", "period", "state", "key").agg(F.count("*").alias("refs"))
    return per_key.groupBy("src", "period", "state").agg(F.sum("refs").alias("refs"), F.count("*").alias("keys"))


def signed_counts(refs: DataFrame, key: str, rows: DataFrame, row_key: str, deleted: str = "deletedAt") -> DataFrame:
    """(key, refs, existing): the current counts of every key, from the deltas of both sides. A deleted row adds 1 and takes 1."""

    def deltas(df: DataFrame, k: Column, ref: Column, exist: Column) -> DataFrame:
        return df.filter(k != "").select(k.alias("key"), ref.cast("long").alias("refs"), exist.cast("long").alias("existing"))

    both = deltas(refs, bare(key), F.lit(1), F.lit(0)).unionByName(
        deltas(rows, bare(row_key), F.lit(0), F.lit(1) - F.when(F.col(deleted).isNotNull(), 1).otherwise(0))
    )
    return both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))
