"""Forward returns over disjoint horizons, and the clock filters before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expr import col, safe_div, seconds_of_day
from tidebook.functions.windows import DAY, lead, series

#: Start and end of each horizon in bars after the prediction time.
HORIZONS = ((0, 5), (5, 30), (30, 60), (60, 120), (120, 300), (300, 600), (600, 900))
SESSION = (13 * 3600 + 30 * 60, 20 * 3600)


def target_name(start: int, end: int) -> str:
    return f"ret_{start}_{end}s"


TARGETS = tuple(target_name(*h) for h in HORIZONS)


def with_targets(df: DataFrame, price: str = "mid_price", horizons: Sequence[tuple[int, int]] = HORIZONS, width_us: int = 1_000_000, keys: Sequence[str] = DAY) -> DataFrame:
    """Adds predictionTimestamp (the bar's end) and price[t+1+end] / price[t+1+start] - 1 for each horizon; null at the
    day's tail. Rows are counted, so gaps must be filled and the session cut before."""
    w = series(keys)
    out = {target_name(a, b): safe_div(lead(price, 1 + b, w), lead(price, 1 + a, w)) - 1.0 for a, b in horizons}
    return df.withColumns({"predictionTimestamp": F.col("ts_event") + F.lit(width_us), **out})


def after_warm_up(df: DataFrame, seconds: int = 900, keys: Sequence[str] = DAY, time: str = "ts_event") -> DataFrame:
    """Rows at least ``seconds`` after their symbol-day's first."""
    first = F.min(time).over(Window.partitionBy(*keys))
    return df.withColumn("__first", first).where(F.col(time) - F.col("__first") >= F.lit(seconds * 1_000_000)).drop("__first")


def in_session(time: str | Column = "ts_event", start: int = SESSION[0], end: int = SESSION[1]) -> Column:
    """Time of day (UTC, whole seconds) within the session, both ends included."""
    return seconds_of_day(col(time)).between(start, end)


def seasonality(df: DataFrame, time: str = "ts_event") -> DataFrame:
    """Adds tod_sin, tod_cos, frac_open, frac_close and auction relative to the frame's earliest and latest time of
    day: one global minimum and maximum, joined back as one row."""
    df = df.withColumn("__tod", seconds_of_day(time))
    ends = df.agg(F.min("__tod").alias("__lo"), F.max("__tod").alias("__hi"))
    df = df.crossJoin(F.broadcast(ends))  # one row
    frac = F.least(F.greatest((F.col("__tod") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)), F.lit(0.0)), F.lit(1.0))
    angle = frac * F.lit(6.283185307179586)
    near = (F.col("__tod") - F.col("__lo") < 300) | (F.col("__hi") - F.col("__tod") < 300)
    return df.withColumns({"tod_sin": F.sin(angle), "tod_cos": F.cos(angle), "frac_open": frac, "frac_close": F.lit(1.0) - frac, "auction": near.cast("double")}).drop("__tod", "__lo", "__hi")
