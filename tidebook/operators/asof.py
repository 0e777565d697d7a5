"""Backward as-of joins as one union, one window over times and one equi-join, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, prefix: str, columns: Sequence[str], on: str = "ts_event", by: Sequence[str] = (), slices: Sequence[str] = ("date",), tolerance: int | None = None, stale_after_ms: int = 5000, times: DataFrame | None = None) -> DataFrame:
    """Each left row with the last right row at or before it: {prefix}_{column}, ts_{prefix}, {prefix}_age_ms (999999
    if there is none) and {prefix}_stale_flag. Of right rows at one time the greatest row counts.

    The left side's distinct times and the right rows are stacked, and the last right row is carried forward over
    (by, slices); left rows then meet their time's result by an equi-join on (by, slices, on), so they are spread over
    times and never pass a window, and several sources join one partitioning. Where a slice (a date) has left rows
    before its first right row, they take the last right row of the slices before: each slice hands on one row, and
    these rows, one a slice, are carried in their own small window. So no task holds more than a slice of the right
    side. Left rows whose time or key is null find nothing. ``left`` is read twice, once for its times alone,
    unless ``times`` has them (by, slices, on; others may be among them).
    """
    keys = [*by, *slices]
    row = F.struct(F.col(on).alias("__t"), *[F.col(c).alias(c) for c in columns])
    latest = right.where(F.col(on).isNotNull()).groupBy(*keys, on).agg(F.max(row).alias("__r"))
    times = (left if times is None else times).where(F.col(on).isNotNull()).select(*keys, on).distinct()
    stacked = times.select(*keys, on, F.lit(1).alias("__side"), F.lit(None).cast(latest.schema["__r"].dataType).alias("__r"))
    stacked = stacked.unionByName(latest.select(*keys, on, F.lit(0).alias("__side"), "__r"))
    w = Window.partitionBy(*keys).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = stacked.withColumn("__own", F.last("__r", ignorenulls=True).over(w)).where("__side = 1").select(*keys, on, "__own")
    if slices:
        ends = latest.groupBy(*keys).agg(F.max("__r").alias("__end"))
        heads = seen.select(*keys).distinct().join(ends, keys, "full")
        before = Window.partitionBy(*by).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
        carried = heads.withColumn("__before", F.last("__end", ignorenulls=True).over(before)).select(*keys, "__before")
        seen = seen.join(carried, keys, "left").withColumn("__own", F.coalesce("__own", "__before"))
    if tolerance is not None:
        seen = seen.withColumn("__own", F.when(F.col(on) - F.col("__own")["__t"] <= tolerance, F.col("__own")))
    new = [f"{prefix}_{c}" for c in columns] + [f"ts_{prefix}"]
    found = seen.select(*keys, on, *[F.col("__own")[c].alias(n) for c, n in zip([*columns, "__t"], new)])
    out = left.join(found, [*keys, on], "left").select(*left.columns, *new)
    age = F.coalesce(F.floor((F.col(on) - F.col(f"ts_{prefix}")) / 1000).cast("long"), F.lit(999999).cast("long"))
    return out.withColumn(f"{prefix}_age_ms", age).withColumn(f"{prefix}_stale_flag", (F.col(f"{prefix}_age_ms") > stale_after_ms).cast("int"))
