"""Walk-forward folds over distinct times or days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_bounds(df: DataFrame, n_splits: int, purge_us: int, time: str = "ts_event") -> DataFrame:
    """(fold, test_start, test_end, cutoff): the distinct times cut into n_splits + 1 equal parts; fold k tests on part
    k + 1 (from test_start up to and including test_end) and trains on times before cutoff = test_start - purge.

    Times are numbered within days and days by their running sizes; only the few bounding times are looked up."""
    ranked = _numbered(df.select(time).where(F.col(time).isNotNull()).distinct(), time)
    total = ranked.count()
    edges = [int(i * total / (n_splits + 1)) for i in range(n_splits + 2)]
    wanted = sorted({e for e in edges if e < total} | {e - 1 for e in edges if e > 0})
    found = {r["__i"]: r[time] for r in ranked.where(F.col("__i").isin(wanted)).collect()}  # at most 2 (n + 2) rows
    rows = [(k, found[edges[k + 1]], found[edges[k + 2] - 1], found[edges[k + 1]] - purge_us) for k in range(n_splits) if edges[k + 1] < edges[k + 2]]
    return df.sparkSession.createDataFrame(rows, "fold int, test_start long, test_end long, cutoff long")


def _numbered(times: DataFrame, time: str) -> DataFrame:
    # numbers within days, plus the days' running sizes: the second window holds a row a day
    day = times.select(time, F.floor(F.col(time) / F.lit(86_400_000_000)).alias("__day"))
    own = day.withColumn("__n", F.row_number().over(Window.partitionBy("__day").orderBy(time)) - 1)
    sizes = day.groupBy("__day").count().withColumn("__base", F.sum("count").over(Window.orderBy("__day")) - F.col("count"))
    return own.join(F.broadcast(sizes.select("__day", "__base")), "__day").select(time, (F.col("__n") + F.col("__base")).alias("__i"))


def fold_split(df: DataFrame, bounds: DataFrame, train_days: int = 0, time: str = "ts_event", date: str = "date") -> DataFrame:
    """Adds fold and split: a row belongs to each fold in which it trains or tests. With train_days only the last so
    many dates before a fold's cutoff train."""
    both = df.join(F.broadcast(bounds), (F.col(time) <= F.col("test_end")) & ((F.col(time) < F.col("cutoff")) | (F.col(time) >= F.col("test_start"))))
    both = both.withColumn("split", F.when(F.col(time) >= F.col("test_start"), "test").otherwise("train"))
    if train_days > 0:
        dates = both.where("split = 'train'").select("fold", date).distinct()
        kept = dates.withColumn("__r", F.dense_rank().over(Window.partitionBy("fold").orderBy(F.col(date).desc()))).where(F.col("__r") <= train_days)
        both = both.join(F.broadcast(kept.drop("__r").withColumn("__kept", F.lit(True))), ["fold", date], "left").where("split = 'test' or __kept").drop("__kept")
    return both.drop("test_start", "test_end", "cutoff")


def day_folds(days: Sequence[str], train_days: int = 0, test_days: int = 2) -> Iterator[tuple[int, list[str], list[str]]]:
    """(fold, train days, test days): a window of days that steps by test_days; no purge, as a night lies between."""
    days = sorted(days)
    size = train_days if train_days > 0 else min(5, len(days) - 1)
    fold, start = 0, 0
    while size > 0 and start + size < len(days):
        yield fold, days[start : start + size], days[start + size : start + size + test_days]
        fold, start = fold + 1, start + test_days
