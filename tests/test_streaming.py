"""Streams give what the batch operators give on the same rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidebook.functions.ewm import recursive_z
from tidebook.operators.bars import aggregate_bars
from tidebook.operators.kalman import innovations
from tidebook.streaming import pipelines as S


@pytest.fixture()
def feed(spark, tmp_path):
    """Writes parts as files of one directory and runs a stream over them, one file a batch, into a table."""

    def run(parts, make, schema=None, stop_after=None):
        path, mark, out = f"{tmp_path}/in", f"{tmp_path}/mark", f"{tmp_path}/out"
        for i, p in enumerate(parts):
            spark.createDataFrame(p).coalesce(1).write.mode("overwrite").parquet(f"{path}/part={i:03d}")
        stream = spark.readStream.schema(spark.read.parquet(f"{path}/part=000").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return spark.read.parquet(out).toPandas()

    return run


def test_stream_bars(spark, feed):
    rng = np.random.default_rng(0)
    t0 = dt.datetime(2024, 1, 2)
    n = 200
    pdf = pd.DataFrame({"ts": [t0 + dt.timedelta(milliseconds=int(150 * i)) for i in range(n)], "symbol": rng.choice(["A", "B"], n), "sequence": range(n), "action": rng.choice(list("ACT"), n), "side": rng.choice(list("AB"), n), "size": rng.integers(1, 9, n).astype(float), "bid_px_00": rng.normal(size=n)})
    pdf = pd.concat([pdf, pd.DataFrame([{**pdf.iloc[-1].to_dict(), "ts": t0 + dt.timedelta(hours=1), "sequence": n, "symbol": "Z"}])])
    got = feed([pdf[:90], pdf[90:150], pdf[150:]], lambda s: S.stream_bars(s))
    batch = aggregate_bars(spark.createDataFrame(pdf).withColumn("ts_us", F.unix_micros("ts")), time_us="ts_us").where("symbol <> 'Z'").toPandas()
    got = got[got.symbol != "Z"]
    key = lambda d: sorted(zip(d.symbol, d.msg_count, d.bid_px_00, d.size_added_bid, d.trade_size_sell, strict=True))
    assert len(got) > 20 and key(got) == key(batch)


def test_stream_dedup(feed):
    t0 = dt.datetime(2024, 1, 2)
    rows = pd.DataFrame({"ts": [t0, t0, t0 + dt.timedelta(seconds=1)], "symbol": "A", "sequence": [1, 1, 2]})
    assert len(feed([rows[:1], rows[1:]], lambda s: S.stream_dedup(s))) == 2


@pytest.mark.parametrize("daily", [False, True])
def test_state_runs_through_batches(feed, daily):
    x = np.random.default_rng(1).normal(size=90)
    rows = pd.DataFrame({"symbol": "A", "ts_event": range(90), "date": ["2024-01-02"] * 40 + ["2024-01-03"] * 50, "x": x})
    got = feed([rows[:25].sample(frac=1, random_state=0), rows[25:60], rows[60:]], lambda s: S.stream_z(s, 20, daily)).sort_values("ts_event")
    want = np.concatenate([recursive_z(x[:40], 20)[0], recursive_z(x[40:], 20)[0]]) if daily else recursive_z(x, 20)[0]
    np.testing.assert_allclose(got["z"].to_numpy(float), want, equal_nan=True)


def test_stream_kalman(feed):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    rows = pd.DataFrame({"symbol": "A", "ts_event": range(60), "y": 1 + 2 * x, "x": x})
    got = feed([rows[:20], rows[20:]], S.stream_kalman).sort_values("ts_event")
    np.testing.assert_allclose(got["epsilon"].to_numpy(float), innovations(rows.y.to_numpy(), rows[["x"]].to_numpy())[0])


def test_stream_asof(feed):
    rows = pd.DataFrame([("ES", "equity", "A", 1, 0.0), ("ES", "macro", "ES", 2000, 7.0), ("ES", "equity", "A", 2000, 0.0), ("ES", "equity", "B", 9_000_000, 0.0)], columns=["source", "kind", "symbol", "ts_event", "value"])
    got = feed([rows[:3], rows[3:]], S.stream_asof)
    assert sorted(zip(got.symbol, got.ts_event, got.macro.fillna(-1), got.age_ms, got.stale, strict=True)) == [("A", 1, -1.0, 999999, 1), ("A", 2000, 7.0, 0, 0), ("B", 9_000_000, 7.0, 8998, 1)]


def test_stream_to_cache_is_idempotent(spark, tmp_path):
    from tidebook.sources.cache import cached_days, read_days

    src = f"{tmp_path}/src"
    for d in (1, 2):
        spark.createDataFrame([(dt.date(2024, 1, d), d)], "date date, x int").write.mode("append").parquet(src)
    stream = spark.readStream.schema("date date, x int").option("maxFilesPerTrigger", 1).parquet(src)
    for mark in ("m1", "m2"):
        S.stream_to_cache(stream, f"{tmp_path}/cache", f"{tmp_path}/{mark}", lambda b: b).awaitTermination(120)
    assert cached_days(spark, f"{tmp_path}/cache") == ["2024-01-01", "2024-01-02"] and read_days(spark, f"{tmp_path}/cache").count() == 2
