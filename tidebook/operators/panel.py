"""Dense (time, node) panels in long form: completion, forward fill, train-only standardisation, target validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expr import clip, finite_or, safe_div


def time_index(df: DataFrame, time: str = "ts_event") -> DataFrame:
    """(time, ti, day): distinct times numbered from 0 and their dates numbered from 0. Numbers within days plus the
    days' running sizes: no window holds more than a day, or a row a day."""
    times = df.select(time, "date").distinct()
    own = times.withColumn("__n", F.row_number().over(Window.partitionBy("date").orderBy(time)) - 1)
    sizes = times.groupBy("date").count()
    along = Window.orderBy("date")
    sizes = sizes.select("date", (F.sum("count").over(along) - F.col("count")).alias("__base"), (F.dense_rank().over(along) - 1).alias("day"))
    return own.join(F.broadcast(sizes), "date").select(time, (F.col("__n") + F.col("__base")).alias("ti"), "day")


def dense_panel(df: DataFrame, nodes: DataFrame, columns: Sequence[str], time: str = "ts_event", node: str = "symbol") -> DataFrame:
    """Every (time, node) pair with ti, day, present and the columns, null where the node has no row then. ``nodes`` is
    the small node dimension; the grid is times by nodes, and rows come in by one equi-join."""
    grid = time_index(df, time).crossJoin(F.broadcast(nodes.select(node).distinct()))
    rows = df.groupBy(time, node).agg(F.max(F.struct(*columns)).alias("__r")).select(time, node, *[F.col("__r")[c].alias(c) for c in columns], F.lit(True).alias("present"))
    return grid.join(rows, [time, node], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def forward_filled(panel: DataFrame, columns: Sequence[str], node: str = "symbol", by_day: bool = False) -> DataFrame:
    """The last value before a gap, 0 before the first; runs through days unless by_day.

    Gaps are filled within a node's day. Through days, each day hands on its last values, and these rows, one a node
    and day, are carried in their own small window: no task holds more than a node's day of the panel."""
    keys = [node, "day"]
    w = Window.partitionBy(*keys).orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    out = panel.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    if by_day:
        return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    ends = panel.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("ti", F.col(c).alias("v"))))["v"].alias(f"__{c}") for c in columns])
    before = Window.partitionBy(node).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *[F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    out = out.join(carried, keys, "left").withColumns({c: F.coalesce(c, f"__{c}", F.lit(0.0)) for c in columns})
    return out.select(*panel.columns)


def train_stats(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column (1 where it hardly varies)."""
    out = []
    for c in columns:
        sd = F.stddev_pop(c)
        out += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}__mean"), F.when(sd > 1e-8, sd).otherwise(1.0).alias(f"{c}__std")]
    return panel.agg(*out)


def standardised(panel: DataFrame, stats: DataFrame, columns: Sequence[str], limit: float = 10.0) -> DataFrame:
    """Columns in training units, clipped; stats is one row."""
    out = panel.crossJoin(F.broadcast(stats))
    return out.withColumns({c: finite_or(clip((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std"), -limit, limit)) for c in columns}).drop(*stats.columns)


def all_finite(targets: Sequence[str]) -> Column:
    """Present, and every target finite."""
    fine = F.col("present")
    for t in targets:
        fine = fine & F.coalesce(F.abs(F.col(t)) < F.lit(float("inf")), F.lit(False))
    return fine


def target_scales(panel: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row: each target's population deviation over the rows whose targets are all finite (1 if 0)."""
    return panel.where(all_finite(targets)).agg(*[F.when(F.stddev_pop(t) > 0, F.stddev_pop(t)).otherwise(1.0).alias(f"{t}__std") for t in targets])


def scaled_targets(panel: DataFrame, scales: DataFrame, targets: Sequence[str], limit: float = 8.0) -> DataFrame:
    """Targets in training deviations, clipped and 0 where missing; target_valid where the row is present and all are
    finite."""
    out = panel.withColumn("target_valid", all_finite(targets)).crossJoin(F.broadcast(scales))
    return out.withColumns({t: F.coalesce(clip(safe_div(F.nanvl(t, F.lit(None).cast("double")), f"{t}__std"), -limit, limit), F.lit(0.0)) for t in targets}).drop(*scales.columns)
