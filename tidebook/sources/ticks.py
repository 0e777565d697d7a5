"""Raw market-by-price ticks: day listing, reading, cleaning."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.expr import scaled_price

LEVELS = 10
DAY_IN_NAME = re.compile(r"(20\d{6})")


def tick_schema(levels: int = LEVELS) -> T.StructType:
    """The explicit ingest schema; nothing is inferred from files."""
    s, n = T.StringType(), T.LongType()
    fields = [("ts_event", n), ("symbol", s), ("sequence", n), ("action", s), ("side", s), ("price", n), ("size", n), ("depth", n)]
    fields += [(f"{side}_{what}_{i:02d}", n) for i in range(levels) for side in ("bid", "ask") for what in ("px", "sz", "ct")]
    return T.StructType([T.StructField(*f) for f in fields])


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, through the file system Spark reads by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().toString() for f in found)


def list_days(spark: SparkSession, pattern: str) -> dict[str, list[str]]:
    """Day (yyyymmdd in the file name) to its files, in order of day; files without a day are left out."""
    days: dict[str, list[str]] = {}
    for f in list_files(spark, pattern):
        found = DAY_IN_NAME.search(f.rsplit("/", 1)[-1])
        if found:
            days.setdefault(found[1], []).append(f)
    return dict(sorted(days.items()))


def files_for_days(spark: SparkSession, pattern: str, days: Iterable[str]) -> list[str]:
    """Only the files of some days: pruning before anything is read."""
    wanted = set(days)
    return [f for d, files in list_days(spark, pattern).items() if d in wanted for f in files]


def read_ticks(spark: SparkSession, source: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """A lazy scan of a glob or a list of files; FileNotFoundError if there are none."""
    files = list_files(spark, source) if isinstance(source, str) else list(source)
    if not files:
        raise FileNotFoundError(f"no files match {source!r}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*files)


def read_sources(spark: SparkSession, sources: Mapping[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Several named tick sources; one that can't be read becomes a warning, not a failure."""
    good, bad = {}, {}
    for name, pattern in sources.items():
        try:
            good[name] = read_ticks(spark, pattern)
        except FileNotFoundError as e:
            bad[name] = str(e)
    return good, bad


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Names from the footers alone."""
    return spark.read.parquet(path).schema.names


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the last by ``order``; ties are broken by all other columns, so the result is fixed.

    Aggregates a maximum struct, which combines before the shuffle: a hot key costs a row a task, and nothing is
    sorted."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in ordered])).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col("best")[c].alias(c) for c in df.columns])


def clean_ticks(df: DataFrame, keys: Sequence[str] = ("ts_event", "symbol", "sequence"), scale: bool = True) -> DataFrame:
    """Drop rows without a time, keep the last of repeated messages, scale fixed-point prices and cast sizes."""
    df = latest_per_key(df.where(F.col("ts_event").isNotNull()), keys, [])
    if scale:
        df = df.withColumns({c: scaled_price(c) for c in df.columns if "px" in c or c == "price"})
    return df.withColumns({c: F.col(c).cast("double") for c in ("size", "depth") if c in df.columns})


def numbered_days(df: DataFrame, date: str = "date") -> DataFrame:
    """Adds day, 0 for the first date: a rank over the few distinct dates, joined back."""
    dates = df.select(date).distinct().withColumn("day", F.dense_rank().over(Window.orderBy(date)) - 1)
    return df.join(F.broadcast(dates), date)
