"""The flagship job over a stream: pings to classified window records, in update mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tramline.config import CONFIG, Config
from tramline.operators import schedule, spacing


def records(pings: DataFrame, trips: DataFrame, shapes: DataFrame, routes: DataFrame, scheduled: DataFrame, active: DataFrame | None, c: Config = CONFIG) -> DataFrame:
    """Streaming window records of two vehicles or more.

    pings: a stream of ping columns with `ts`. The static tables are read once, when the query starts. The watermark
    follows the on-route filter, so a stray clock off the route can't move it.
    """
    placed = spacing.project(pings, trips, shapes, routes).withWatermark("ts", c.watermark)
    services = None if active is None else active.groupBy("date").agg(F.collect_set("serviceId").alias("services"))
    return spacing.stream_records(placed, schedule.timetable(scheduled), services).filter("vehicleCount >= 2")


def start(rows: DataFrame, checkpoint: str, batch, once: bool = False, c: Config = CONFIG) -> StreamingQuery:
    """Run `batch` (sinks.fan_out) on every micro-batch; once: drain what is there and stop."""
    w = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=c.trigger)).start()
