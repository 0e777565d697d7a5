"""Expressions, windows, recurrences and formulas on cases with known answers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidebook.functions import ewm
from tidebook.functions import windows as W
from tidebook.functions.expr import clip, finite_or, not_null, repaired, rounded, safe_div, scaled_price, sum_of
from tidebook.operators import formulas as G
from tidebook.operators import trajectories as TR
from tidebook.operators.features import prices, ranks

DAY = dt.date(2024, 1, 2)


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    df = spark.createDataFrame(pd.DataFrame({"symbol": ["A"] * n, "date": [DAY] * n, "ts_event": range(n), **columns}))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t == "double"})


def column(df, name, order="ts_event"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_expressions(spark):
    df = spark.createDataFrame([(2**63 - 1, 1.0, 0.0, float("nan"), None), (1_500_000_000, 4.0, 2.0, float("inf"), 3.0)], "p long, a double, b double, c double, d double")
    rows = df.select(scaled_price("p"), safe_div("a", "b"), repaired("c"), clip("d", 0, 2), sum_of(["a", "d"]), finite_or("c", 1.0, 9.0), rounded(F.lit(0.0000005)), not_null(["c", "d"])).collect()
    assert tuple(rows[0]) == (None, None, 0.0, None, 1.0, 1.0, 1e-06, False)
    assert tuple(rows[1]) == (1.5, 2.0, float("inf"), 2.0, 7.0, 9.0, 1e-06, True)


def test_gates_shifts_and_lookahead(spark):
    df = frame(spark, x=[1.0, None, 3.0, 4.0, 5.0, 6.0])
    assert column(df.withColumn("y", W.gated(F.sum, "x", 3)), "y") == [None, None, None, None, 12.0, 15.0]
    assert column(df.withColumn("y", W.gated(F.sum, "x", 3, 2)), "y") == [None, None, 4.0, 7.0, 12.0, 15.0]
    assert column(df.withColumn("y", W.ahead(F.max, "x", 2)), "y") == [3.0, 4.0, 5.0, 6.0, None, None]
    assert column(df.withColumn("y", W.shifted("ts_event", 2)), "y") == [0, 0, 0, 1, 2, 3]
    assert column(df.withColumn("y", W.shifted("ts_event", -2)), "y") == [2, 3, 4, 5, 5, 5]
    assert column(df.withColumn("y", W.filled("x")), "y") == [1.0, 1.0, 3.0, 4.0, 5.0, 6.0]


def test_long_moments_equal_frames(spark):
    rng = np.random.default_rng(0)
    x = 1e6 + rng.normal(size=400)
    x[[3, 50, 51]] = np.nan
    df = frame(spark, x=x)
    got = W.with_long_moments(df, [("sum", "x", 100, "s"), ("std", "x", 100, "d")]).orderBy("ts_event").toPandas()
    want = pd.Series(x).rolling(100)
    np.testing.assert_allclose(got["s"].astype(float), want.sum(), rtol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got["d"].astype(float), want.std(), rtol=1e-7, equal_nan=True)


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None)], "ts_event int, x double")
    got = {(r.x, r.a, r.p) for r in df.select("x", W.average_rank("x", ["ts_event"]).alias("a"), W.percentile_rank("x").alias("p")).collect()}
    assert got == {(5.0, 1.5, 0.125), (7.0, 3.0, -0.25), (None, None, None)}


def test_average_rank_of_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (1, 7.0), (1, None)], "ts_event int, x double")
    for descending, five in ((False, 1.0), (True, 2.0)):
        got = {(r.x, r.a, r.p) for r in df.select("x", W.average_rank("x", ["ts_event"], descending, nulls=True).alias("a"), W.percentile_rank("x", "ts_event", descending, nulls=True).alias("p")).collect()}
        assert got == {(5.0, five, five / 4 - 0.5), (7.0, 3.0 - five, (3.0 - five) / 4 - 0.5), (None, 3.5, 0.375)}


def test_spread_over_no_price_ranks_as_infinite(spark):
    rows = [(1, "A", -0.01, 0.01), (1, "B", 1.0, 1.5), (1, "C", 2.0, 2.1), (1, "D", None, 2.0), (1, "E", 0.01, -0.01)]
    df = prices(spark.createDataFrame([(*r, r[1]) for r in rows], "ts_event long, symbol string, bid_px_00 double, ask_px_00 double, date string"))
    df = df.withColumns({c: F.lit(0.0) for c in ("ofi_raw_z180", "obi_L1", "cvd_60s_z180", "mom_60s")})
    got = {r.symbol: r.rank_spread_bps for r in ranks(df).collect()}
    assert got["D"] is None and {k: round((v + 0.5) * 5) for k, v in got.items() if v is not None} == {"E": 1, "C": 2, "B": 3, "A": 4}


def test_weighted_statistics_match_pandas():
    x = np.random.default_rng(1).normal(100, 3, 500)
    x[:4] = np.nan
    mean, std = ewm.weighted_mean_std(x, 20)
    e = pd.Series(x).ewm(halflife=20)
    np.testing.assert_allclose(mean, e.mean(), equal_nan=True)
    np.testing.assert_allclose(std[5:], e.std()[5:])
    assert std[4] == 0.0


@pytest.mark.parametrize("halflife", [5, 180])
def test_columns_at_once_match_pandas(halflife):
    x = np.column_stack([100 + np.cumsum(np.random.default_rng(k).normal(size=5000)) for k in range(3)] + [np.full(5000, 7.0)])
    mean, std = ewm.weighted_mean_std_columns(x, halflife)
    e = pd.DataFrame(x).ewm(halflife=halflife)
    np.testing.assert_allclose(mean, e.mean(), rtol=1e-11)
    np.testing.assert_allclose(std[1:, :3], e.std().to_numpy()[1:, :3], rtol=1e-7)
    assert not std[0].any() and not std[:, 3].any()


def test_recursive_z_moments_sign_and_state():
    x = np.random.default_rng(7).normal(size=10_000)
    z, _ = ewm.recursive_z(x, 1000)
    assert abs(np.nanmean(z[5000:])) < 0.3 and abs(np.nanstd(z[5000:]) - 1) < 0.5
    z, _ = ewm.recursive_z(np.tile([1.0, -1.0], 300), 100)
    assert (z[~np.isnan(z)] > 0).any() and (z[~np.isnan(z)] < 0).any()
    whole, _ = ewm.recursive_z(x[:200], 50)
    first, state = ewm.recursive_z(x[:77], 50)
    rest, _ = ewm.recursive_z(x[77:200], 50, *state)
    np.testing.assert_array_equal(whole, np.concatenate([first, rest]))


def test_days_start_afresh_and_the_future_is_unseen(spark):
    n = 60
    x = np.random.default_rng(3).normal(size=2 * n)
    pdf = pd.DataFrame({"symbol": "A", "date": [DAY] * n + [DAY + dt.timedelta(1)] * n, "ts_event": range(2 * n), "x": x})
    specs = [ewm.Spec("mean", "x", 10, "m"), ewm.Spec("z", "x", 10, "z"), ewm.Spec("quantile", "x", 20, "q")]
    run = lambda p: ewm.with_ewm(spark.createDataFrame(p).repartition(3), specs).orderBy("ts_event").toPandas()
    base = run(pdf)
    assert base["m"][n] == pytest.approx(x[n])
    changed = run(pdf.assign(x=np.where(pdf.index > 80, 99.0, x)))
    pd.testing.assert_frame_equal(base[:81], changed[:81])


def test_book_formulas(spark):
    df = frame(spark, b=[99.50, 99.51, 99.52], a=[99.51, 99.52, 99.53], bs=[100.0, 50.0, 200.0], s=[100.0, 200.0, 50.0])
    row = df.select(G.spread_bps("b", "a"), G.microprice("b", "a", "bs", "s"), G.obi_level("bs", "s"), "b", "a").orderBy("b").collect()
    assert all(r[3] <= r[1] <= r[4] and r[0] == pytest.approx(1.005, abs=0.01) for r in row)
    assert [r[2] for r in row] == pytest.approx([0.0, -0.6, 0.6])
    none = spark.range(1).select(G.obi_level(F.lit(0.0), F.lit(0.0)), G.bid_share(F.lit(0.0), F.lit(0.0)), G.microprice(F.lit(1.0), F.lit(3.0), F.lit(0.0), F.lit(0.0))).first()
    assert tuple(none) == (None, 0.5, 2.0)
    with pytest.raises(ValueError):
        G.top_book_size(["a"], ["b"], 2)
    with pytest.raises(ValueError):
        G.z_sweep(df, "b", True, True, [10])


def test_trajectory_shapes(spark):
    t = np.arange(50.0)
    shapes = {"flat": np.full(50, 3.0), "up": t, "down": -t, "bowl": (t - 25) ** 2}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in shapes.items()], "k string, traj array<double>")
    got = {r.k: r for r in TR.with_descriptors(df, dt=1.0).collect()}
    assert got["flat"].slope == 0 and got["flat"].net_change == 0 and got["flat"].monotonicity == 0 and got["flat"].efficiency is None and got["flat"].drift_vol is None
    assert got["up"].net_change == 49 and got["up"].monotonicity == 1 and got["up"].efficiency == 1 and got["up"].slope == pytest.approx(1)
    assert got["down"].monotonicity == 0 and got["down"].slope == pytest.approx(-1)
    assert got["bowl"].curvature == pytest.approx(1) and got["up"].curvature == pytest.approx(0, abs=1e-9)
    short = spark.createDataFrame([([1.0, None, 2.0],)], "traj array<double>")
    r = TR.with_descriptors(short).first()
    assert r.slope is None and r.curvature is None and r.net_change == 1.0 and r.monotonicity is None


def test_trajectories_end_at_the_anchor(spark):
    df = spark.createDataFrame([("A", i, float(i), i in (0, 50)) for i in range(100)], "symbol string, bar int, x double, is_anchor boolean")
    got = {r.bar: r.traj for r in TR.with_trajectories(df, "x", 10, 0).collect()}
    assert got[50] == [float(i) for i in range(41, 51)] and got[0] == [None] * 9 + [0.0]
    assert {r.bar: r.traj for r in TR.with_trajectories(df, "x", 10, -10).collect()}[50][-1] == 40.0
    with pytest.raises(ValueError):
        TR.with_trajectories(df, "x", 10, 1)
