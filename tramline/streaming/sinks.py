"""Sinks of the streaming job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.status import alertable


def console_rows(records: DataFrame, *tie: str) -> DataFrame:
    """The twelve tightest alertable records, rounded for reading."""
    top = records.filter(alertable("status")).orderBy("headwayRatio", *tie).limit(12)
    return top.select(
        "headwayGroup", *tie, F.round("minGapMetres", 0).alias("gap"), F.round("headwayRatio", 2).alias("ratio"), F.round(F.col("observedHeadwaySeconds") / 60, 1).alias("minutes"), "status"
    )


def keyed_json(rows: DataFrame, key: str, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep, key, value): every row as JSON without its null fields."""
    return rows.select(*(keep or []), F.col(key).alias("key"), F.to_json(F.struct(*(columns or rows.columns))).alias("value"))


def fan_out(alerts: Callable[[DataFrame, int], None], records: Callable[[DataFrame, int], None], show: Callable[[list], None] | None = None):
    """A foreachBatch function: one persisted batch to console, alert sink and record sink. Empty batches do nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if batch.isEmpty():
                return
            if show:
                show(console_rows(batch).collect())  # twelve rows at most
            alerts(keyed_json(batch.filter(alertable("status")), "headwayGroup"), batch_id)
            records(keyed_json(batch, "headwayGroup"), batch_id)
        finally:
            batch.unpersist()

    return run


def folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """JSON lines, one folder per batch: a batch that is run again replaces its own output."""
    return lambda rows, batch_id: rows.select("value").write.mode("overwrite").text(f"{path}/batch={batch_id}")


def kafka_sink(servers: str, topic: str) -> Callable[[DataFrame, int], None]:
    return lambda rows, batch_id: rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
