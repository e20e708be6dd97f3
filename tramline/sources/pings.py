"""Ping logs and record topics: Kafka where its connector is there, else folders of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline import schema
from tramline.config import CONFIG


def log_stream(spark: SparkSession, source: dict) -> DataFrame:
    """A stream of (key, value) strings.

    source: {"kind": "kafka", "servers": ..., "topic": ..., "starting": "latest"} or {"kind": "files", "path": ...,
    "per_trigger": n}: every line of the folder's files is a value.
    """
    if source["kind"] == "kafka":
        r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", source["servers"]).option("subscribe", source["topic"])
        r = r.option("startingOffsets", source.get("starting", "latest")).option("maxOffsetsPerTrigger", source.get("per_trigger", CONFIG.max_offsets))
        return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"))
    files = spark.readStream.schema("value string").option("maxFilesPerTrigger", source.get("per_trigger", 1)).text(source["path"])
    return files.select(F.lit(None).cast("string").alias("key"), "value")


def parse(values: DataFrame, as_schema: T.StructType, value: str = "value") -> DataFrame:
    """Fields of JSON values; unknown ones are ignored, missing ones null, broken records all null."""
    return values.select(F.from_json(F.col(value).cast("string"), as_schema).alias("p")).select("p.*")


def parse_pings(values: DataFrame) -> DataFrame:
    """Pings with the ids that a trip lookup needs."""
    return parse(values, schema.PING).filter("vehicleId is not null and tripId is not null")


def split_malformed(values: DataFrame, value: str, as_schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed fields, malformed values); null values are skipped."""
    p = values.filter(F.col(value).isNotNull()).select(F.col(value), F.from_json(value, f"{as_schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    bad = F.col("p._corrupt").isNotNull()
    return p.filter(~bad).select("p.*").drop("_corrupt"), p.filter(bad).select(value)


def json_value(row: Column) -> Column:
    """JSON of a struct without its null fields; null for null."""
    return F.when(row.isNotNull(), F.to_json(row))


def publish(pings: DataFrame, sink: dict) -> None:
    """Write pings as JSON keyed by route: to Kafka with full acknowledgement, or to a folder."""
    cols = [F.col(f.name) for f in schema.PING.fields]
    rows = pings.select(F.col("routeId").alias("key"), json_value(F.struct(*cols)).alias("value"))
    if sink["kind"] == "kafka":
        w = rows.write.format("kafka").option("kafka.bootstrap.servers", sink["servers"]).option("topic", sink["topic"])
        w.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("kafka.linger.ms", "20").option("kafka.compression.type", "lz4").option("kafka.max.block.ms", "10000").save()
    else:
        rows.select("value").write.mode("append").text(sink["path"])
