"""Parquet tables of a data folder, one folder or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.session import utc


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{root}/{name}.parquet")
