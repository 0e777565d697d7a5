"""Walk-forward evaluation: folds, a regressor for each horizon, signal metrics, both simulators, a text report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators import metrics as M
from tidebook.operators import simulators as S
from tidebook.operators.folds import day_folds, fold_bounds, fold_split
from tidebook.operators.models import fit_horizon, predict_horizon
from tidebook.operators.panel import time_index
from tidebook.operators.targets import TARGETS
from tidebook.sources.cache import written
from tidebook.sources.report import as_text, over_folds

KEEP = ("symbol", "date", "ts_event", "spread_bps", "ret_bps", "bid_sz_00", "ask_sz_00", "trade_size_buy", "trade_size_sell", "microprice_dev_bps", "mom_60s_z180", "rank_mom_60s")


def tagged_folds(df: DataFrame, n_splits: int = 5, purge_us: int = 900_000_000, train_days: int = 0) -> DataFrame:
    """Rows with fold and split, cut by time with a purge before each test part."""
    return fold_split(df, fold_bounds(df, n_splits, purge_us), train_days)


def tagged_days(df: DataFrame, train_days: int = 0, test_days: int = 2) -> DataFrame:
    """Rows with fold and split, cut by whole days (a night lies between, so nothing is purged)."""
    days = [str(r[0]) for r in df.select("date").distinct().orderBy("date").collect()]  # a value a day
    rows = [(k, d, s) for k, train, test in day_folds(days, train_days, test_days) for s, part in (("train", train), ("test", test)) for d in part]
    plan = df.sparkSession.createDataFrame(rows, "fold int, __day string, split string")
    return df.join(F.broadcast(plan), F.col("date").cast("string") == F.col("__day")).drop("__day")


def predictions(tagged: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGETS, kind: str = "trees", least_train: int = 1000, least_test: int = 100, **model) -> DataFrame | None:
    """(fold, horizon, KEEP columns, score, y) of every fold's test rows; folds with too few rows are left out. The
    rows are written once, and each fold reads its own."""
    rows = written(tagged, "folds")
    keep = [c for c in KEEP if c in rows.columns]
    out: DataFrame | None = None
    for fold in [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]:  # a value a fold
        train, test = (rows.where((F.col("fold") == fold) & (F.col("split") == s)) for s in ("train", "test"))
        if test.limit(least_test).count() < least_test:
            continue
        for h, target in enumerate(targets):
            fitted = fit_horizon(train, features, target, kind, seed=fold, least_rows=least_train, **model)
            if fitted is None:
                continue
            scored = predict_horizon(fitted, test, features, "score").select(F.lit(fold).alias("fold"), F.lit(h).alias("horizon"), *keep, "score", F.col(target).alias("y"))
            out = scored if out is None else out.unionByName(scored)
    return out if out is None else written(out, "predictions")


def signal_metrics(scored: DataFrame, least_names: int = 5, overlap: dict[int, int] | None = None) -> DataFrame:
    """(fold, horizon) rank correlation with its robust t, two baselines' rank correlations with theirs, AUC, hit rate
    and information ratio with robust t, error. ``overlap``: lags of a horizon's t-statistics, its length in rows (1
    where it isn't given). The momentum baseline is mom_60s_z180, else rank_mom_60s."""
    keys = ["fold", "horizon"]
    out = M.pair_metrics(scored, "score", "y", keys).join(M.auc(scored, "score", F.col("y") > 0, keys), keys)
    momentum = next((c for c in ("mom_60s_z180", "rank_mom_60s") if c in scored.columns), None)
    wanted = [("rank", "score"), *[(n, c) for n, c in (("micro", "microprice_dev_bps"), ("mom", momentum)) if c in scored.columns]]
    parts: dict[str, DataFrame] = {}
    for h in sorted(overlap or {r[0]: 1 for r in scored.select("horizon").distinct().collect()}):  # a value a horizon
        rows, lags = scored.where(F.col("horizon") == h), (overlap or {}).get(h, 1)
        found = {n: M.rank_ic(rows, c, "y", least_names=least_names, overlap=lags, by=keys).select(*keys, F.col("mean_ic").alias(f"{n}_ic"), F.col("t").alias(f"{n}_ic_t")) for n, c in wanted}
        found["pair"] = M.pair_tstats(rows, "score", "y", lags, by=keys)
        parts = {n: parts[n].unionByName(df) if n in parts else df for n, df in found.items()}
    for df in parts.values():
        out = out.join(df, keys, "left")
    return out


def simulator_rows(scored: DataFrame) -> DataFrame:
    """The simulators' long input: every test row carries a score of its own."""
    per_fold = scored.select("fold", "ts_event", "date").distinct()
    times = time_index(per_fold.select("ts_event", "date"))
    rows = scored.join(times, "ts_event")
    named = {"bid_sz_00": "bid_sz", "ask_sz_00": "ask_sz", "trade_size_buy": "buy_vol", "trade_size_sell": "sell_vol"}
    return rows.withColumnsRenamed(named).withColumns({"day": F.col("day").cast("int"), "scored": F.lit(True), "valid": F.col("score").isNotNull(), "ret1s": F.col("ret_bps") / 1e4})


def simulations(scored: DataFrame, rebalance: dict[int, int], k: int = 5, buffer: int | None = None, band: float = 0.0, gate: float = 0.0, signal_horizon: int = 0, scale: dict[int, float] | None = None, extra_cost_bps: float = 0.0, maker_gate: float = 0.0, **maker) -> tuple[DataFrame, DataFrame]:
    """Portfolio metrics by fold and horizon, and the market maker's by fold and arm for one horizon's score. Without a
    ``buffer`` held names stay within 2 k ranks. ``scale`` turns a horizon's score into a return; ``maker`` are the
    market maker's settings."""
    rows = simulator_rows(scored)
    portfolio = S.portfolio_summary(S.long_short(rows, rebalance, k, buffer if buffer and buffer > 0 else 2 * k, band, gate, scale, extra_cost_bps))
    mine = rows.where(F.col("horizon") == signal_horizon)
    makers = None
    for fold in [r[0] for r in mine.select("fold").distinct().orderBy("fold").collect()]:
        one = S.maker_summary(S.market_making(mine.where(F.col("fold") == fold), scale=scale[signal_horizon] if scale else 1.0, gate=maker_gate, **maker)).withColumn("fold", F.lit(fold))
        makers = one if makers is None else makers.unionByName(one)
    return portfolio, makers


def report(metrics: DataFrame, portfolio: DataFrame | None = None, makers: DataFrame | None = None) -> str:
    """The text report: means and deviations over folds."""
    parts = [as_text(over_folds(metrics), "Signal metrics by horizon", ["horizon"])]
    if portfolio is not None:
        parts.append(as_text(over_folds(portfolio), "Long/short portfolio by horizon", ["horizon"]))
    if makers is not None:
        parts.append(as_text(over_folds(makers, "arm"), "Market maker by arm", ["arm"]))
    return "\n".join(parts)


