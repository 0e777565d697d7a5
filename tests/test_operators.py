"""Operators whose answers follow from small inputs or from an independent loop."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidebook.operators import event_study as ES
from tidebook.operators import graph as GR
from tidebook.operators import metrics as M
from tidebook.operators import models, panel
from tidebook.operators import simulators as S
from tidebook.operators.asof import asof_join
from tidebook.operators.bars import make_bars
from tidebook.operators.folds import day_folds
from tidebook.operators.kalman import with_kalman
from tidebook.sources import cache, report
from tidebook.sources import ticks as T

US = 1_000_000


def test_clean_ticks_and_bars(spark):
    rows = [(0, "A", 1, "A", "B", 5, 100), (0, "A", 1, "A", "B", 7, 100), (10, "A", 2, "T", "A", 3, 2**63 - 1), (3 * US, "A", 3, "C", "B", 2, 300), (None, "A", 4, "A", "B", 1, 1)]
    df = spark.createDataFrame(rows, "ts_event long, symbol string, sequence long, action string, side string, size long, bid_px_00 long")
    clean = T.clean_ticks(df)
    assert sorted(r["size"] for r in clean.collect()) == [2.0, 3.0, 7.0]
    bars = make_bars(clean, US, time_us="ts_event", columns=["bid_px_00"]).orderBy("ts_event").collect()
    assert [(r.ts_event, r.bid_px_00, r.msg_count, r.size_added_bid, r.trade_size_sell, r.size_canceled_bid) for r in bars] == [(0, None, 2, 7.0, 3.0, 0.0), (US, None, 0, 0.0, 0.0, 0.0), (2 * US, None, 0, 0.0, 0.0, 0.0), (3 * US, 300 * 1e-9, 1, 0.0, 0.0, 2.0)]


def test_listing_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3)], "date date, x int")
    for d in ("20240101", "20240102"):
        df.where(F.col("x") == int(d[-1])).coalesce(1).write.parquet(f"{tmp_path}/raw/q-{d}.parquet")
    assert list(T.list_days(spark, f"{tmp_path}/raw/*")) == ["20240101", "20240102"]
    assert len(T.files_for_days(spark, f"{tmp_path}/raw/*", ["20240102", "20250101"])) == 1
    with pytest.raises(FileNotFoundError):
        T.read_ticks(spark, f"{tmp_path}/none/*")
    good, bad = T.read_sources(spark, {"ES": f"{tmp_path}/raw/*", "NQ": f"{tmp_path}/none/*"})
    assert set(good) == {"ES"} and set(bad) == {"NQ"}
    path = f"{tmp_path}/cache"
    built = []

    def build(day):
        built.append(day)
        return df.where(F.date_format("date", "yyyyMMdd") == day)

    cache.build_cache(spark, ["20240101", "20240102"], build, path)
    cache.build_cache(spark, ["20240102", "20240103"], build, path)
    assert built == ["20240101", "20240102", "20240103"] and cache.cached_days(spark, path) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert cache.read_days(spark, path, ["2024-01-02"]).count() == 1
    assert "PartitionFilters: [" in cache.read_days(spark, path, ["2024-01-02"])._jdf.queryExecution().toString()


def test_report(spark, tmp_path):
    df = report.over_folds(spark.createDataFrame([(0, 1, 1.0), (1, 1, 3.0)], "fold int, horizon int, ic double"))
    text = report.write_text(df, f"{tmp_path}/out.txt", "Scores", ["horizon"])
    assert "2.000000" in text and "1.000000" in text and open(f"{tmp_path}/out.txt").read() == text


def test_asof_ties_slices_and_tolerance(spark):
    left = spark.createDataFrame([("A", 5, 1), ("A", 10, 1), ("B", 10, 1), ("A", 25, 2), ("A", 2, 1)], "symbol string, ts_event long, date int")
    right = spark.createDataFrame([(5, 1, 1.0), (10, 1, 2.0), (30, 2, 9.0)], "ts_event long, date int, x double")
    got = {(r.symbol, r.ts_event): (r.M_x, r.M_age_ms) for r in asof_join(left, right, "M", ["x"]).collect()}
    assert got == {("A", 2): (None, 999999), ("A", 5): (1.0, 0), ("A", 10): (2.0, 0), ("B", 10): (2.0, 0), ("A", 25): (2.0, 0)}
    near = {r.ts_event: r.M_x for r in asof_join(left.where("symbol = 'A'"), right, "M", ["x"], tolerance=5).collect()}
    assert near[25] is None and near[10] == 2.0


def test_day_folds():
    assert list(day_folds(list("abcdef"), 2, 2)) == [(0, ["a", "b"], ["c", "d"]), (1, ["c", "d"], ["e", "f"])]
    assert list(day_folds(["a", "b", "c"])) == [(0, ["a", "b"], ["c"])] and list(day_folds(["a"])) == []


def test_kalman_finds_a_line(spark):
    x = np.random.default_rng(0).normal(size=800)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts_event": range(800), "x": x, "y": 2.0 + 3.0 * x}))
    df = df.withColumn("y", F.when(F.col("ts_event") != 500, F.col("y")))
    got = with_kalman(df, "y", ["x"]).orderBy("ts_event").toPandas()
    assert abs(got.kalman_epsilon[700:]).max() < 1e-3 and got.kalman_epsilon[500] == 0 and np.isfinite(got.kalman_z_score).all()


def _graph_panel(spark, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=200)
    series = {"a": base + 0.1 * rng.normal(size=200), "b": -base + 0.1 * rng.normal(size=200), "c": np.roll(base, 5), "m": rng.normal(size=200)}
    rows = [(t, 0, n, float(v[t])) for n, v in series.items() for t in range(200)]
    return series, spark.createDataFrame(rows, "ti long, day int, node string, ret double")


def test_graph_statistics_and_relations(spark):
    series, p = _graph_panel(spark)
    nodes = spark.createDataFrame([("a", "equity", 0), ("b", "equity", 1), ("c", "equity", 2), ("m", "macro", None)], "node string, kind string, sector int")
    ends = GR.window_ends(p, (300, 1800)).where("te = 199")
    edges = {(r.src, r.dst): r for r in GR.dynamic_edges(p, nodes, ends, top_k=0).collect()}
    a, b = series["a"], series["b"]
    want = np.cov(a, b)[0, 1] / (a.std() * b.std())
    assert edges["b", "a"].corr == pytest.approx(want) and edges["b", "a"].rel == GR.NEG
    assert edges["a", "a"].corr == pytest.approx(200 / 199) and edges["a", "a"].rel == GR.SELF
    lead = edges["a", "c"]  # c follows a by 5
    x, y = series["c"][5:], a[:-5]
    assert lead.lead_lag_5s == pytest.approx(np.cov(x, y)[0, 1] / (x.std() * y.std())) and lead.rel == GR.LEADLAG
    assert edges["b", "a"].vol_ratio == pytest.approx(np.log(a.std() / b.std()))
    alone = GR.dynamic_edges(p, nodes, ends, ablate=True).collect()
    assert {(r.src, r.dst, r.rel) for r in alone} == {(n, n, 0) for n in "abcm"}
    moved = GR.batch_offsets(spark.createDataFrame([(1, 0, 2), (5, 1, 2)], "te int, src int, dst int"), 4)
    assert {(r.te, r.src, r.dst) for r in moved.collect()} == {(1, 0, 2), (5, 5, 6)}


def test_graph_at_every_window_end(spark):
    series, p = _graph_panel(spark)
    p = p.withColumn("day", (F.col("ti") >= 120).cast("int"))
    got = GR.every_end_stats(p, 40, 5, "", seq=30, block=16).toPandas().set_index(["te", "i", "j"]).sort_index()
    ends = [te for te in range(200) if te - (120 if te >= 120 else 0) >= 29]
    assert len(got) == len(ends) * 16
    for te in ends:
        lo = max(te - 40, 120 if te >= 120 else 0)
        for i, j in (("a", "a"), ("a", "b"), ("c", "a"), ("m", "c")):
            x, y = series[i][lo : te + 1], series[j][lo : te + 1]
            row = got.loc[te, i, j]
            cov = np.cov(x, y)[0, 1]
            assert row["n"] == len(x) and row["corr"] == pytest.approx(cov / (x.std() * y.std())) and row["beta"] == pytest.approx(np.clip(cov / y.var(), -5, 5))
            x, y = x[5:], y[:-5]
            assert row["ll"] == pytest.approx(np.cov(x, y)[0, 1] / (x.std() * y.std()))
    by_join = GR.pair_stats(p, GR.window_ends(p, (40,)), "lo_40", 5, "").where(f"te in ({','.join(map(str, ends))})").toPandas().set_index(["te", "i", "j"]).sort_index()
    np.testing.assert_allclose(got.to_numpy(float), by_join[got.columns].to_numpy(float), atol=1e-9)


def test_graph_queries_cover_every_window_end(spark):
    from tests.conftest import SMALL

    from tidebook.plans.queries import QUERIES

    times = QUERIES["panel_dense"](spark, SMALL).select("ti", "day").distinct().toPandas()
    start = times.groupby("day").ti.transform("min")
    want = set(times.ti[times.ti - start >= 29])
    for name in ("corr_edges", "edges_topk"):
        got = QUERIES[name](spark, SMALL).where("rel = 0").select("te", "src").toPandas()
        assert set(got.te) == want and len(got) == 8 * len(want), name


def test_every_bar_has_descriptors(spark):
    from tests.conftest import SMALL

    from tidebook.plans.queries import QUERIES, mids

    bars = mids(spark, SMALL).groupBy("symbol").count().toPandas()
    got = QUERIES["traj_descriptors"](spark, SMALL).groupBy("symbol").agg(F.count("*").alias("n"), F.count("slope").alias("slopes")).toPandas()
    both = bars.merge(got, on="symbol")
    assert (both.n == both["count"] - 1).all() and (both.slopes == both["count"] - 4).all()  # the first has no past; slopes take 4


def test_macro_row_is_the_last_one(spark):
    from tests.conftest import SMALL

    from tidebook.plans.queries import QUERIES, mids

    times = np.sort(mids(spark, SMALL).where("symbol = 'S7'").select("ts_event").toPandas().ts_event.to_numpy())
    got = QUERIES["asof_macro"](spark, SMALL).select("ts_event", "ts_ES").toPandas()
    at = np.searchsorted(times, got.ts_event.to_numpy(), "right") - 1
    want = np.where(at >= 0, times[np.maximum(at, 0)], -1)
    assert (got.ts_ES.fillna(-1).to_numpy() == want).all()


def test_stale_flag_after_a_gap(spark):
    left = spark.createDataFrame([(0, 4_000_000), (0, 6_000_000), (0, 6_001_000)], "date long, ts_event long")
    right = spark.createDataFrame([(0, 1_000_000, 7.0)], "date long, ts_event long, v double")
    rows = {r.ts_event: r for r in asof_join(left, right, "ES", ["v"]).collect()}
    assert [(rows[t].ES_age_ms, rows[t].ES_stale_flag) for t in sorted(rows)] == [(3000, 0), (5000, 0), (5001, 1)]


def test_newey_west_by_loop(spark):
    x = np.cumsum(np.random.default_rng(2).normal(size=120)) * 0.1 + 0.3
    for lags in (0, 1, 7, 500):
        e, n = x - x.mean(), len(x)
        most = min(max(lags, 0), n - 1)
        s = (e @ e) / n + 2 * sum((1 - k / (most + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, most + 1))
        row = M.newey_west(spark.createDataFrame(pd.DataFrame({"i": range(n), "x": x})), "x", "i", lags).first()
        assert row.t == pytest.approx(x.mean() / np.sqrt(max(s, 1e-18) / n))
    assert M.newey_west(spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, x double"), "x", "i", 1).first().t == 0.0


def test_small_metrics(spark):
    df = spark.createDataFrame([(t, float(i), float(i * (1 if t < 9 else -1))) for t in range(10) for i in range(6)], "ts_event int, p double, y double")
    row = M.rank_ic(df, "p", "y").first()
    assert row.n == 10 and row.mean_ic == pytest.approx(0.8)
    assert M.rank_ic(df.where("p < 3"), "p", "y").count() == 0 or M.rank_ic(df.where("p < 3"), "p", "y").first().mean_ic == 0.0
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert M.auc(one, "s", F.col("y") > 0).first().auc == 0.5
    two = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0)], "s double, y int")
    assert M.auc(two, "s", F.col("y") > 0).first().auc == 0.75
    assert M.two_sided_p(0.0, 20) == pytest.approx(1.0) and M.two_sided_p(0.4438, 20) == pytest.approx(0.05, abs=1e-3)


def test_lift_bootstrap_stability(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"d": d, "f": 0.1 * d + 0.5 * rng.normal(size=20_000)}))
    got = {r.direction: r for r in ES.lift_over_noise(df, "d", "f").collect()}
    assert got["long"].lift_std_units > 0 > got["short"].lift_std_units and got["long"].n_triggers == 2000
    assert ES.lift_over_noise(df.limit(100), "d", "f").count() == 0
    means = [1.0, 2.0, 1.5, 1.0, 1.0]
    rows = spark.createDataFrame([(k, m + float(rng.normal()) * 0.1) for k, m in enumerate(means) for _ in range(20)], "day int, value double")
    draws = ES.random_draws(rows.select("day"), 200)
    assert draws.count() == 1000
    ci = ES.bootstrap_lift(rows, draws, 0.0, 1.0).first()
    assert 0 < ci.ci_low <= ci.median <= ci.ci_high
    assert ES.bootstrap_lift(rows, draws.where("boot < 5"), 0.0, 1.0).first().median is None
    days = lambda n, s: spark.createDataFrame(list(zip(range(8), n, s, strict=True)), "day_index int, n int, s double")
    ok = ES.stability(days([10] * 8, [5.0] * 8), 0.0, 1.0, 0.5).first()
    assert ok.pass_A and ok.pass_B and ok.pass_C and ok.pass_D and ok.pass_F and ok.pass_all
    assert not ES.stability(days([10] * 8, [5.0] * 4 + [-5.0] * 4), 0.0, 1.0, 0.5).first().pass_A
    assert not ES.stability(days([10] * 7 + [0], [5.0] * 7 + [0.0]), 0.0, 1.0, 0.5).first().pass_F


def test_event_classes(spark):
    rows = [(10.0, 12.0, 0.0, 1.0, 1.0, 1), (-10.0, 0.0, -12.0, 1.0, 1.0, 2), (0.0, 12.0, 0.0, 1.0, 1.0, 3), (0.0, 1.0, 0.0, 3.0, 1.0, 4), (0.0, 1.0, 0.0, 1.0, 3.0, 5), (None, 1.0, 0.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "R_end double, R_high double, R_low double, RV_fwd double, RV_trail double, want int")
    assert all(r.got == r.want for r in df.select(ES.event_class(10.0).alias("got"), "want").collect())


def test_dense_panel(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), "A", 2.0), (2, dt.date(2024, 1, 1), "B", 3.0), (3, dt.date(2024, 1, 2), "A", None)], "ts_event long, date date, symbol string, x double")
    p = panel.dense_panel(df, df.select("symbol"), ["x"])
    got = {(r.ti, r.symbol): (r.day, r.present, r.x) for r in panel.forward_filled(p, ["x"]).collect()}
    assert got == {(0, "A"): (0, True, 2.0), (0, "B"): (0, False, 0.0), (1, "A"): (0, False, 2.0), (1, "B"): (0, True, 3.0), (2, "A"): (1, True, 2.0), (2, "B"): (1, False, 3.0)}
    scaled = panel.scaled_targets(p, panel.target_scales(p, ["x"]), ["x"])
    assert {(r.ti, r.symbol) for r in scaled.where("target_valid").collect()} == {(0, "A"), (1, "B")}


def _sim(spark, T=80, names=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(0, 0, t, t // 40, f"n{i}", float(rng.normal()), t % 4 == 0, bool(rng.random() > 0.1), float(rng.normal() * 1e-3), 2.0, 5.0, 6.0, float(rng.random() * 9), float(rng.random() * 9)) for t in range(T) for i in range(names)]
    return rows, spark.createDataFrame(rows, "fold int, horizon int, ti long, day int, symbol string, score double, scored boolean, valid boolean, ret1s double, spread_bps double, bid_sz double, ask_sz double, buy_vol double, sell_vol double")


def test_portfolio_accounts(spark):
    """Exposure, cost and the flatten charge add up; ranks without a buffer equal a plain sort."""
    rows, df = _sim(spark)
    got = S.long_short(df, {0: 4}, k=2).orderBy("t").toPandas()
    by = {(r[2], r[4]): r for r in rows}
    weights, want = {}, []
    for day in (0, 1):
        weights = dict.fromkeys([f"n{i}" for i in range(6)], 0.0)
        for t in range(40 * day, 40 * day + 39 - 4 + 1, 4):
            ok = sorted((n for n in weights if by[t, n][7]), key=lambda n: (-by[t, n][5], n))
            target = dict.fromkeys(weights, 0.0)
            longs = ok[:2]
            shorts = [n for n in ok[::-1][:2] if n not in longs]
            if len(ok) >= 2 and longs and shorts:
                target |= dict.fromkeys(longs, 0.5 / len(longs)) | dict.fromkeys(shorts, -0.5 / len(shorts))
            gross = sum(w * (np.prod([1 + by[u, n][8] for u in range(t + 1, t + 5)]) - 1) for n, w in target.items())
            turnover = sum(abs(target[n] - weights[n]) for n in weights)
            want.append([day, t, gross - turnover * 1e-4, gross, turnover])
            weights = target
        want[-1][2] -= sum(map(abs, weights.values())) * 1e-4
        want[-1][4] += sum(map(abs, weights.values()))
    np.testing.assert_allclose(got[["day", "t", "net", "gross", "turnover"]].to_numpy(float), np.array(want), atol=1e-12)
    summary = S.portfolio_summary(S.long_short(df, {0: 4}, k=2)).first()
    assert summary.n_intervals == len(want) and summary.max_drawdown >= 0
    assert S.long_short(df, {0: 4}, k=2, gate=1e9).toPandas().names.sum() == 0
    calm = S.long_short(df, {0: 4}, k=2, band=10.0).toPandas()
    assert calm.turnover.sum() == 0
    assert S.portfolio_summary(S.long_short(df.where("ti < 12"), {0: 4}, k=2)).first().net_sharpe == 0.0


def test_hysteresis():
    assert S.pick_side([3, 1, 2, 0], {2}, 2, 3) == [2, 3] and S.pick_side([3, 1, 2, 0], {0}, 2, 3) == [3, 1] and S.pick_side([], {1}, 2, 3) == []


def test_market_maker(spark):
    rows, df = _sim(spark)
    paths = S.market_making(df, inventory_limit=1.0).toPandas()
    assert set(paths.arm) == {"signal", "baseline"} and len(paths) == 24
    q = pnl = 0.0
    mine = [r for r in rows if r[4] == "n0" and r[3] == 0]
    for t in range(39):
        r = mine[t]
        edge = -0.5 * q
        b = 0.0 if edge < 0 or q >= 1 else min(min(1, 0.25 * r[13] / 6.0), max(0, 1 - q))
        s = 0.0 if edge > 0 or q <= -1 else min(min(1, 0.25 * r[12] / 7.0), max(0, 1 + q))
        q += b - s
        pnl += 1e-4 * (b + s) + mine[t + 1][8] * q
    pnl -= abs(q) * 1e-4
    assert paths[(paths.arm == "baseline") & (paths.symbol == "n0") & (paths.day == 0)].pnl.iloc[0] == pytest.approx(pnl)
    out = {r.arm: r for r in S.maker_summary(S.market_making(df)).collect()}
    assert out["signal"].n_days == 2 and out["baseline"].fill_rate > 0


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2))
    df = spark.createDataFrame(pd.DataFrame({"ts_event": np.arange(1500) // 10, "a": x[:, 0], "b": x[:, 1], "y": x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=1500)}))
    model = models.fit_horizon(df, ["a", "b"], "y", kind="huber")
    got = models.predict_horizon(model, df, ["a", "b"], "p").agg(F.corr("p", "y")).first()[0]
    assert got > 0.9 and models.fit_horizon(df.limit(50), ["a", "b"], "y") is None
    assert models.cross_sectional_loss(df.withColumn("p", F.col("y")), "p", "y").first().loss == pytest.approx(-0.5)


def test_network_pieces():
    rng = np.random.default_rng(0)
    x, kernel = rng.normal(size=(2, 20)), rng.normal(size=(3, 2, 3))
    y = models.causal_convolution(x, kernel, np.zeros(3), 2)
    later = x.copy()
    later[:, 11:] = 9.0
    np.testing.assert_allclose(models.causal_convolution(later, kernel, np.zeros(3), 2)[:, :11], y[:, :11])
    assert y[0, 10] == pytest.approx(sum(kernel[0, c, j] * x[c, 10 - 2 * (2 - j)] for c in range(2) for j in range(3)))
    assert models.temporal_encoder(x, [(rng.normal(size=(2, 2, 3)), np.zeros(2))] * 2).shape == (2,)
    h, src, dst = rng.normal(size=(3, 2)), np.array([0, 1, 2, 0]), np.array([0, 1, 1, 2])
    out = models.graph_attention(h, src, dst, np.zeros((4, 1)), np.eye(2), np.eye(2), np.zeros((1, 2)), np.ones(2))
    np.testing.assert_allclose(out[[0, 2]], h[[0, 0]])
    assert min(h[1, 0], h[2, 0]) <= out[1, 0] <= max(h[1, 0], h[2, 0])


def test_forward_fill_through_days(spark):
    """Days without any value hand on what they were given; by_day starts anew."""
    rows = [(0, 0, "A", 1.0), (1, 0, "A", None), (2, 1, "A", None), (3, 2, "A", None), (4, 2, "A", 5.0), (0, 0, "B", None), (4, 2, "B", None)]
    p = spark.createDataFrame(rows, "ti long, day int, symbol string, x double")
    got = {(r.ti, r.symbol): r.x for r in panel.forward_filled(p, ["x"]).collect()}
    assert got == {(0, "A"): 1.0, (1, "A"): 1.0, (2, "A"): 1.0, (3, "A"): 1.0, (4, "A"): 5.0, (0, "B"): 0.0, (4, "B"): 0.0}
    assert {r.ti: r.x for r in panel.forward_filled(p.where("symbol = 'A'"), ["x"], by_day=True).collect()} == {0: 1.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 5.0}


def test_target_scales_take_rows_with_every_target(spark):
    rows = [(True, 1.0, 2.0), (True, 3.0, 4.0), (True, 100.0, None), (True, 50.0, float("nan")), (True, 9.0, float("inf")), (False, 7.0, 7.0)]
    p = spark.createDataFrame(rows, "present boolean, y double, z double")
    scales = panel.target_scales(p, ["y", "z"])
    assert tuple(scales.first()) == (1.0, 1.0)
    assert sorted((r.y, r.z, r.target_valid) for r in panel.scaled_targets(p, scales, ["y", "z"]).collect()) == [(1.0, 2.0, True), (3.0, 4.0, True), (7.0, 7.0, False), (8.0, 0.0, False), (8.0, 0.0, False), (8.0, 8.0, False)]


def test_asof_with_null_times_and_given_times(spark):
    day = dt.date(2024, 1, 1)
    left = spark.createDataFrame([("A", day, 5), ("A", day, 5), ("B", day, 9), ("C", day, None), ("D", None, 9)], "symbol string, date date, ts_event long")
    right = spark.createDataFrame([(day, 4, 1.0), (day, 9, 2.0), (day, 9, 3.0), (day, None, 7.0)], "date date, ts_event long, x double")
    want = [("A", 1.0, 4), ("A", 1.0, 4), ("B", 3.0, 9), ("C", None, None), ("D", None, None)]
    times = spark.createDataFrame([(day, t) for t in (1, 5, 7, 9)], "date date, ts_event long")
    for given in (None, times):
        out = asof_join(left, right, "M", ["x"], times=given)
        assert out.columns == ["symbol", "date", "ts_event", "M_x", "ts_M", "M_age_ms", "M_stale_flag"]
        assert sorted((r.symbol, r.M_x, r.ts_M) for r in out.collect()) == want


def _split_rows(spark, seed=3):
    """Two days, three equities and a source; A misses a time, B a feature, the last targets are missing."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(16):
        es = (float(rng.normal()), float(rng.normal()), int(t % 5 == 4))
        for s in "ABC":
            if (s, t) == ("A", 3):
                continue
            f = None if (s, t) == ("B", 9) else float(rng.normal())
            y = None if t % 8 >= 6 else float(rng.normal())
            rows.append((t * 1_000_000, dt.date(2024, 1, 1 + t // 8), s, float(rng.normal()), f, y, es[0], es[1], es[2]))
    return rows, spark.createDataFrame(rows, "ts_event long, date date, symbol string, ret_bps double, spread_bps double, y double, ES_ret_bps double, ES_spread_bps double, ES_stale_flag int")


def test_prepare_split_and_its_graphs(spark):
    from tidebook.plans.split import prepare_split, split_graphs

    rows, df = _split_rows(spark)
    split = prepare_split(df, ["spread_bps"], ["y"], ["A", "B"], ["ES"])
    got = {(r.ti, r.node): r for r in split.panel.collect()}
    assert len(got) == 16 * 3
    by = {(r[0] // 1_000_000, r[2]): r for r in rows}
    raw, last = {}, {}
    for t in range(16):
        for s in "AB":
            if (t, s) in by and by[t, s][4] is not None:
                last[s] = by[t, s][4]
            raw[t, s] = last.get(s, 0.0)
        raw[t, "ES"] = by[t, "C"][7]
    m, d = np.mean(list(raw.values())), np.std(list(raw.values()))
    sd = np.std([r[5] for r in rows if r[2] in "AB" and r[5] is not None])
    for (t, s), r in got.items():
        assert r.spread == raw[t, s] and r.spread_bps == pytest.approx(np.clip((raw[t, s] - m) / d, -10, 10)) and r.day == t // 8
        own = by.get((t, s))
        assert r.present == (own is not None) and r.stale == (by[t, "C"][8] if s == "ES" else float(own is None))
        assert r.ret == (by[t, "C"][6] if s == "ES" else own[3] if own else 0.0)
        y = own[5] if own else None
        assert r.target_valid == (y is not None) and r.y == pytest.approx(np.clip((y or 0.0) / sd, -8, 8)) and r.y_raw == (y or 0.0)
        assert (r.liquidity, r.residual, r.kind) == (1.0, 0.0, "macro" if s == "ES" else "equity")
    test = prepare_split(df.where("date = '2024-01-02'"), ["spread_bps"], ["y"], ["A", "B"], ["ES"], split.feature_stats, split.scales).panel
    assert {r.spread_bps for r in test.where("node = 'ES'").collect()} == {got[t, "ES"].spread_bps for t in range(8, 16)}
    sectors = spark.createDataFrame([("A", 0), ("B", 0)], "node string, sector int")
    edges = split_graphs(split.panel, sectors, 3).toPandas()
    assert set(edges["te"]) == {2, 3, 4, 5, 10, 11, 12, 13}
    one = edges[(edges["te"] == 5) & (edges["src"] == "B") & (edges["dst"] == "A")].iloc[0]
    x, y = (np.array([got[t, s].ret for t in range(6)]) for s in "AB")
    assert one["rel"] == GR.SECTOR and one["corr"] == pytest.approx(np.cov(x, y)[0, 1] / (x.std() * y.std()))
    alone = split_graphs(split.panel, sectors, 3, ablate=True).collect()
    assert len(alone) == 8 * 3 and all(r.src == r.dst and r.rel == GR.SELF and r.corr == 0.0 for r in alone)
    assert prepare_split(df.limit(0), ["spread_bps"], ["y"], ["A", "B"], ["ES"]).panel.count() == 0


def test_windows_without_rows_have_self_loops(spark):
    _, p = _graph_panel(spark)
    nodes = spark.createDataFrame([(n, "equity", 0) for n in "abcm"], "node string, kind string, sector int")
    ends = spark.createDataFrame([(50, 40, 40), (900, 890, 890)], "te long, lo_300 long, lo_1800 long")
    edges = GR.dynamic_edges(p, nodes, ends).where("te = 900").collect()
    assert {(r.src, r.dst, r.rel, r.corr) for r in edges} == {(n, n, GR.SELF, 0.0) for n in "abcm"}
