"""Regular bars from ticks: tumbling aggregation, gap-free grid, forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.expr import col
from tidebook.functions.windows import filled, series

FLOWS = ("size_added_bid", "size_added_ask", "size_canceled_bid", "size_canceled_ask", "trade_size_buy", "trade_size_sell")


def snapshot_columns(names: Sequence[str]) -> list[str]:
    """Columns that a bar takes the last value of, by name; "action" counts, as its name holds "ct"."""
    return [c for c in names if any(x in c for x in ("px", "sz", "ct")) or c in ("price", "depth", "size")]


def _flow(action: str, side: str) -> Column:
    return F.coalesce(F.sum(F.when((F.col("action") == action) & (F.col("side") == side), F.col("size").cast("double"))), F.lit(0.0))


def aggregate_bars(ticks: DataFrame, width_us: int = 1_000_000, time_us: str | Column = "ts_us", tie: Sequence[str] = ("sequence",), columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each symbol and non-empty bar [t, t + width): last snapshot (a null last value stays null), message
    count and six flows. ts_event is the bar's start in microseconds, date its UTC day.

    The snapshot is a maximum over (time, tie) structs, so partial aggregation combines it before the one shuffle."""
    columns = snapshot_columns(ticks.columns) if columns is None else list(columns)
    time = col(time_us)
    start = F.floor(time / F.lit(width_us)) * F.lit(width_us)
    last = F.max_by(F.struct(*columns), F.struct(time.alias("t"), *tie)).alias("last")
    out = ticks.groupBy("symbol", start.cast("long").alias("ts_event")).agg(
        last, F.count(F.lit(1)).alias("msg_count"),
        _flow("A", "B").alias(FLOWS[0]), _flow("A", "A").alias(FLOWS[1]), _flow("C", "B").alias(FLOWS[2]),
        _flow("C", "A").alias(FLOWS[3]), _flow("T", "B").alias(FLOWS[4]), _flow("T", "A").alias(FLOWS[5]),
    )
    return out.select("symbol", "ts_event", day_of("ts_event").alias("date"), "last.*", "msg_count", *FLOWS)


def day_of(time_us: str | Column) -> Column:
    """UTC date of microseconds since the epoch, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(time_us) / F.lit(86_400_000_000)).cast("int"))


def dense_bars(bars: DataFrame, width_us: int = 1_000_000) -> DataFrame:
    """Fill each symbol's day from its first to its last bar: missing bars take the last snapshot and no flow.

    A bar generates the empty ones up to the next itself (lead, sequence, explode): the grid is never joined."""
    w = series()
    flows = [c for c in ("msg_count", *FLOWS) if c in bars.columns]
    snaps = [c for c in bars.columns if c not in ("symbol", "ts_event", "date", *flows)]
    bars = bars.withColumns({c: filled(c) for c in snaps})
    until = F.coalesce(F.lead("ts_event").over(w), F.col("ts_event") + F.lit(width_us)) - F.lit(width_us)
    steps = bars.withColumn("__until", until).withColumn("__ts", F.explode(F.sequence("ts_event", "__until", F.lit(width_us).cast("long"))))
    real = F.col("__ts") == F.col("ts_event")
    kept = [F.when(real, F.col(c)).otherwise(F.lit(0).cast(bars.schema[c].dataType)).alias(c) if c in flows else F.col(c) for c in bars.columns if c not in ("symbol", "ts_event", "date")]
    return steps.select("symbol", F.col("__ts").alias("ts_event"), "date", *kept)


def make_bars(ticks: DataFrame, width_us: int = 1_000_000, **kwargs) -> DataFrame:
    return dense_bars(aggregate_bars(ticks, width_us, **kwargs), width_us)
