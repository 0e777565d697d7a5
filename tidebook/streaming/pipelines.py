"""Streaming bars, deduplication, day cache, and stateful recurrences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.functions.ewm import recursive_z
from tidebook.operators.bars import FLOWS, _flow, snapshot_columns
from tidebook.operators.kalman import Filter, innovations
from tidebook.sources.cache import write_days


def read_tick_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Tick files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_dedup(ticks: DataFrame, late: str = "5 seconds", keys: tuple[str, ...] = ("ts", "symbol", "sequence")) -> DataFrame:
    """Repeated messages within the watermark go. The first stays, where the batch operator keeps the last: copies of a
    message that differ are the only case that can tell."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def stream_bars(ticks: DataFrame, width: str = "1 second", late: str = "5 seconds", tie: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Tumbling bars of an event-time stream (column ts), emitted once the watermark passes their end."""
    columns = snapshot_columns(ticks.columns)
    last = F.max_by(F.struct(*columns), F.struct(F.col("ts").alias("t"), *tie)).alias("last")
    actions = [("A", "B"), ("A", "A"), ("C", "B"), ("C", "A"), ("T", "B"), ("T", "A")]
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(last, F.count(F.lit(1)).alias("msg_count"), *[_flow(*a).alias(n) for a, n in zip(actions, FLOWS, strict=True)])
    return out.select("symbol", F.col("window.start").alias("ts"), F.to_date("window.start").alias("date"), "last.*", "msg_count", *FLOWS)


def stream_to_cache(stream: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]):
    """Each micro-batch of whole-day files goes through ``build`` into the day cache; replaying a batch replaces the same
    days, so the sink is idempotent."""

    def sink(batch: DataFrame, _: int) -> None:
        write_days(build(batch), path, rebuild=True)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RecursiveZ(StatefulProcessor):
    """z of each value against mean and variance before it, carried through batches for each key; with ``reset_daily``
    a new date starts afresh. Rows of a batch are put in order of time first; a row older than the last one seen still
    counts, in the order it came."""

    def __init__(self, halflife: float, reset_daily: bool = False):
        self.halflife, self.reset_daily = halflife, reset_daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("z", "mean double, var double, started boolean, day string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        mean, var, started, day = tuple(self.state.get()) if self.state.exists() else (0.0, 0.0, False, "")
        data = pd.concat(list(rows)).sort_values("ts_event", kind="stable")
        for today, part in data.groupby(data["date"].astype(str), sort=False) if self.reset_daily else [("", data)]:
            if self.reset_daily and today != day:
                mean, var, started, day = 0.0, 0.0, False, today
            z, (mean, var, started) = recursive_z(part["x"].to_numpy(float), self.halflife, mean, var, started)
            yield pd.DataFrame({"symbol": key[0], "ts_event": part["ts_event"].to_numpy(), "z": z})
        self.state.update((float(mean), float(var), bool(started), day))

    def close(self) -> None:
        pass


def stream_z(rows: DataFrame, halflife: float, reset_daily: bool = False) -> DataFrame:
    """(symbol, ts_event, z) of a stream (symbol, ts_event, x[, date])."""
    return rows.groupBy("symbol").transformWithStateInPandas(RecursiveZ(halflife, reset_daily), "symbol string, ts_event long, z double", "Append", "None")


class KalmanState(StatefulProcessor):
    """Kalman innovations of y on the driver x, the state carried through batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kalman", "theta array<double>, cov array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("ts_event", kind="stable")
        filter_ = Filter(2)
        if self.state.exists():
            theta, cov = self.state.get()
            filter_.theta, filter_.cov = np.array(theta), np.array(cov).reshape(2, 2)
        eps, filter_ = innovations(data["y"].to_numpy(float), data[["x"]].to_numpy(float), filter_)
        self.state.update((filter_.theta.tolist(), filter_.cov.reshape(-1).tolist()))
        yield pd.DataFrame({"symbol": key[0], "ts_event": data["ts_event"].to_numpy(), "epsilon": eps})

    def close(self) -> None:
        pass


def stream_kalman(rows: DataFrame) -> DataFrame:
    """(symbol, ts_event, epsilon) of a stream (symbol, ts_event, y, x)."""
    return rows.groupBy("symbol").transformWithStateInPandas(KalmanState(), "symbol string, ts_event long, epsilon double", "Append", "None")


class LatestMacro(StatefulProcessor):
    """Each equity row with the last macro row at or before it: the latest macro rows are the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("macro", "ts_event long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).assign(order=lambda d: (d["kind"] != "macro").astype(int)).sort_values(["ts_event", "order"], kind="stable")
        macro = data["kind"] == "macro"
        seen = data[["ts_event", "value"]].where(macro).ffill()
        if self.state.exists():
            ts, value = self.state.get()
            seen = seen.fillna({"ts_event": ts, "value": value})
        if macro.any():
            last = data[macro].iloc[-1]
            self.state.update((int(last["ts_event"]), float(last["value"])))
        mine = ~macro
        age = ((data.loc[mine, "ts_event"] - seen.loc[mine, "ts_event"]) // 1000).fillna(999999).astype("int64")
        yield pd.DataFrame({"symbol": data.loc[mine, "symbol"], "ts_event": data.loc[mine, "ts_event"], "macro": seen.loc[mine, "value"], "age_ms": age, "stale": (age > 5000).astype("int32")})

    def close(self) -> None:
        pass


def stream_asof(rows: DataFrame) -> DataFrame:
    """(symbol, ts_event, macro, age_ms, stale) of a stream (source, kind, symbol, ts_event, value), by source."""
    return rows.groupBy("source").transformWithStateInPandas(LatestMacro(), "symbol string, ts_event long, macro double, age_ms long, stale int", "Append", "None")
