"""The per-day Parquet cache: idempotent writes, pruned reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cached_days(spark: SparkSession, path: str) -> list[str]:
    """Days (yyyy-mm-dd) whose partition directory holds a finished write."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date=*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return sorted(f.getPath().getName().removeprefix("date=") for f in found)


def write_days(df: DataFrame, path: str, rebuild: bool = False) -> list[str]:
    """Write a frame with a ``date`` column, one partition a day; days already there are skipped unless rebuilt.
    Only the partitions of the frame's own days are replaced."""
    spark = df.sparkSession
    have = [] if rebuild else cached_days(spark, path)
    fresh = df.where(~F.col("date").cast("string").isin(have)) if have else df
    fresh.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return [d for d in cached_days(spark, path) if d not in have]


def read_days(spark: SparkSession, path: str, days: Iterable[str] | None = None) -> DataFrame:
    """The cache, pruned to some days by its directories."""
    df = spark.read.parquet(path)
    return df if days is None else df.where(F.col("date").cast("string").isin(list(days)))


def build_cache(spark: SparkSession, days: Iterable[str], build: Callable[[str], DataFrame], path: str, rebuild: bool = False) -> list[str]:
    """Day by day, so that a run can stop and go on; a day that is there is not built again."""
    done = []
    for day in days:
        iso = f"{day[:4]}-{day[4:6]}-{day[6:]}" if len(day) == 8 else day
        if rebuild or iso not in cached_days(spark, path):
            done += write_days(build(day), path, rebuild=True)
    return done


_own_dir: str | None = None


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several plans read, in the folder the cluster names in ``spark.checkpoint.dir`` (a folder of
    our own only where it is unset), and read it back: later plans are short and survive lost executors."""
    global _own_dir
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_dir
    if folder is None:
        folder = _own_dir = "file://" + tempfile.mkdtemp(prefix="tidebook-")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
