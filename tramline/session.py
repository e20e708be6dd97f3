"""Session helpers: UTC, ANSI-safe settings, the shared checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tramline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tramline-"), "tramline-package.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("tramline", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def utc(spark: SparkSession) -> SparkSession:
    """The session as every query needs it: all times mean UTC (zone-free timestamps are read in the session's
    zone), and the workers have this package."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset, as in a local test, a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "tramline-checkpoints")


_kept: dict[str, SparkSession] = {}


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; `sweep` removes it."""
    path = f"{shared_folder(spark)}/tramline-kept/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(sweep)
    _kept[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from the written rows."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and go on from the table, so that later scans prune its
    columns. `sweep` removes what this application has kept; it runs when the driver ends."""
    spark = df.sparkSession
    path = fresh(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Remove what `keep` and the users of `fresh` wrote."""
    while _kept:
        path, spark = _kept.popitem()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; the folder is the application's own and can be removed by hand
            return


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; otherwise df as it is, so that the
    join shuffles. The size is counted (up to the bound) before the hint is given."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def one_row(*parts: DataFrame) -> DataFrame:
    """Single rows of different columns as one row, by a union and an aggregate instead of a product."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
