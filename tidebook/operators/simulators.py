"""Path-dependent simulators: a long/short portfolio and a market maker.

Input is long: a row for each (time index, name) with score, validity, return, spread and flows. What a position
depends on runs in one kernel for each independent path; all sums and metrics around it are aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expr import clip, finite_or, safe_div
from tidebook.functions.windows import with_drawdown

RETURN_LIMIT, DAYS_A_YEAR = 0.02, 252


def pick_side(order: list[int], held: set[int], k: int, m: int) -> list[int]:
    """Up to k names, best first in ``order``: those held that still rank within m, then newcomers of the first k,
    then the next best."""
    size = min(k, len(order))
    kept = [i for i in order[:m] if i in held][:size]
    for i in order:
        if len(kept) >= size:
            break
        if i not in kept:
            kept.append(i)
    return kept


def target_weights(score: np.ndarray, fresh: np.ndarray, k: int, m: int, band: float) -> np.ndarray:
    """Weights of one day after each rebalancing (times by names): the best names share +0.5, the worst -0.5. ``score``
    is NaN where a name can't be traded. Without a fresh score, or where less than ``band`` would change, weights stay."""
    weights = np.zeros_like(score)
    held = np.zeros(score.shape[1])
    for now, values, made in zip(weights, score, fresh, strict=True):
        if made:
            names = np.flatnonzero(np.isfinite(values))
            wanted = np.zeros_like(held)
            if len(names) > 1:
                ups, downs = (names[np.argsort(sign * values[names], kind="stable")].tolist() for sign in (-1, 1))
                top = pick_side(ups, set(np.flatnonzero(held > 0).tolist()), k, m)
                low = [i for i in pick_side(downs, set(np.flatnonzero(held < 0).tolist()), k, m) if i not in top]
                if top and low:
                    wanted[top], wanted[low] = 0.5 / len(top), -0.5 / len(low)
            if np.abs(wanted - held).sum() >= band:
                held = wanted
        now[:] = held
    return weights


def day_accounts(weights: np.ndarray, growth: np.ndarray, half: np.ndarray, closing: np.ndarray) -> dict[str, np.ndarray]:
    """Gross, cost and exposure of each interval from the weights held in it, the names' growth over it, and the half
    spreads at its start; the last interval also pays ``closing``, the half spreads at which the day is flattened."""
    traded = np.abs(np.diff(weights, axis=0, prepend=0.0))
    last = np.abs(weights[-1])
    gross, cost, turnover = (weights * growth).sum(axis=1), (traded * half).sum(axis=1), traded.sum(axis=1)
    cost[-1] += last @ closing
    turnover[-1] += last.sum()
    size = np.abs(weights)
    return {"net": gross - cost, "gross": gross, "turnover": turnover, "gross_exposure": size.sum(axis=1), "net_exposure": weights.sum(axis=1), "names": (size > 1e-9).sum(axis=1)}


def day_intervals(score: np.ndarray, fresh: np.ndarray, ret: np.ndarray, half: np.ndarray, rebalance: int, k: int, m: int, band: float, gate: float, scale: float) -> dict[str, np.ndarray]:
    """One day's intervals over dense arrays (times by names): as many whole ones of ``rebalance`` rows as follow the
    first row; ``at`` is the row at which each begins. Shorter days have none."""
    count = (len(ret) - 1) // rebalance if len(ret) > rebalance + 1 else 0
    at = np.arange(count) * rebalance
    if not count:
        return {"at": at}
    known = score[at]
    if gate > 0:  # a name must be expected to earn its round trip
        known = np.where(np.abs(known * scale) >= gate * 2 * half[at], known, np.nan)
    growth = (1 + ret[1 : 1 + count * rebalance]).reshape(count, rebalance, -1).prod(axis=1) - 1
    return {"at": at, **day_accounts(target_weights(known, fresh[at], k, m, band), growth, half[at], half[-1])}


def _prepared(df: DataFrame, extra_cost_bps: float) -> DataFrame:
    """Bad ticks out: missing returns 0, clipped; a missing spread is prohibitive; the last score of the day so far."""
    half = F.greatest(finite_or("spread_bps", 1e6, 1e6, 1e6), F.lit(0.0)) / 2e4 + extra_cost_bps / 1e4
    w = Window.partitionBy("fold", "horizon", "symbol", "day").orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    made = F.col("scored")
    held = F.last(F.when(made, F.struct("score", "valid")), ignorenulls=True).over(w)
    return df.withColumns({"ret": clip(finite_or("ret1s"), -RETURN_LIMIT, RETURN_LIMIT), "half": half, "held": held})


INTERVALS = "fold int, horizon int, day int, t long, net double, gross double, turnover double, gross_exposure double, net_exposure double, names int"


def long_short(df: DataFrame, rebalance: dict[int, int], k: int = 5, buffer: int | None = None, band: float = 0.0, gate: float = 0.0, scale: dict[int, float] | None = None, extra_cost_bps: float = 0.0) -> DataFrame:
    """Intervals of the long/short portfolio for each (fold, horizon): ``df`` has fold, horizon, ti, day, symbol, score,
    scored (a score was made at that time), valid, ret1s, spread_bps. Every day starts and ends flat, so a day is one
    path; days, folds and horizons run apart. A ``buffer`` over k lets held names stay while they rank within it."""
    m = max(k, buffer or k)
    scales = scale or {}
    score = F.when(F.col("held")["valid"], F.col("held")["score"])
    cols = ["fold", "horizon", "ti", "day", "symbol", "ret", "half", score.alias("score"), F.col("held").isNotNull().alias("fresh")]
    names = [c.split()[0] for c in INTERVALS.split(", ")]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, horizon, day = (int(pdf[c].iloc[0]) for c in ("fold", "horizon", "day"))
        wide = pdf.set_index(["ti", "symbol"])[["score", "fresh", "ret", "half"]].unstack("symbol").sort_index()
        of = lambda c, fill: wide[c].astype(float).fillna(fill).to_numpy()
        values = of("score", np.nan)
        values[~np.isfinite(values)] = np.nan
        out = day_intervals(values, of("fresh", 0.0).any(axis=1), of("ret", 0.0), of("half", 50.0), rebalance[horizon], k, m, band, gate, scales.get(horizon, 1.0))
        at = out.pop("at")
        return pd.DataFrame({"fold": fold, "horizon": horizon, "day": day, "t": wide.index.to_numpy()[at], **{c: out.get(c, np.zeros(0)) for c in names[4:]}}, index=range(len(at)))[names]

    return _prepared(df, extra_cost_bps).select(*cols).groupBy("fold", "horizon", "day").applyInPandas(kernel, INTERVALS)


def portfolio_summary(intervals: DataFrame) -> DataFrame:
    """(fold, horizon) metrics of the intervals: Sharpe ratios, annual return, turnover, cost drag, drawdown; fewer
    than 5 intervals give zeros."""
    keys = ["fold", "horizon"]
    days = intervals.groupBy(*keys, "day").count().groupBy(*keys).agg(F.avg("count").alias("per_day"))
    walked = with_drawdown(intervals, "net", keys, "t")
    out = walked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.avg("net").alias("nm"), F.stddev_pop("net").alias("ns"), F.avg("gross").alias("gm"), F.stddev_pop("gross").alias("gs"),
        F.avg("turnover").alias("to"), F.max("drawdown").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        F.avg("gross_exposure").alias("avg_gross_exp"), F.avg("net_exposure").alias("avg_net_exp"), F.avg("names").alias("avg_n_pos"),
    ).join(days, keys)
    year = F.col("per_day") * DAYS_A_YEAR
    values = {
        "net_sharpe": F.coalesce(safe_div("nm", "ns") * F.sqrt(year), F.lit(0.0)), "net_ann_return": F.col("nm") * year, "gross_sharpe": F.coalesce(safe_div("gm", "gs") * F.sqrt(year), F.lit(0.0)),
        "turnover_ann": F.col("to") * year, "cost_drag_ann": (F.col("gm") - F.col("nm")) * year, **{c: F.col(c) for c in ("max_drawdown", "hit_rate", "avg_gross_exp", "avg_net_exp", "avg_n_pos")},
    }
    return out.select(*keys, "n_intervals", *[F.when(F.col("n_intervals") >= 5, v).otherwise(0.0).alias(c) for c, v in values.items()])


def stateless_long_short(df: DataFrame, k: int, time: str = "ts_event", keys: Sequence[str] = ("date",)) -> DataFrame:
    """The portfolio without buffer or band, in windows alone: at each time the k best scores at +0.5 / n, the k worst at
    -0.5 / n (a name on both sides stays long), cost on the change since the name's last time, gross on next_ret.
    ``df`` has time, symbol, score, half_spread, next_ret."""
    at = [*keys, time]
    up = Window.partitionBy(*at).orderBy(F.col("score").desc(), "symbol")
    down = Window.partitionBy(*at).orderBy(F.col("score").asc(), "symbol")
    rows = df.where(F.col("score").isNotNull()).withColumns({"__u": F.row_number().over(up), "__d": F.row_number().over(down)})
    side = F.when(F.col("__u") <= k, 1).when(F.col("__d") <= k, -1).otherwise(0)
    rows = rows.withColumn("__side", side)
    every = Window.partitionBy(*at)
    n_long, n_short = F.sum((F.col("__side") == 1).cast("int")).over(every), F.sum((F.col("__side") == -1).cast("int")).over(every)
    both = (n_long > 0) & (n_short > 0)
    weight = F.when(both & (F.col("__side") == 1), 0.5 / n_long).when(both & (F.col("__side") == -1), -0.5 / n_short).otherwise(0.0)
    rows = rows.withColumn("weight", weight)
    rows = rows.withColumn("__dw", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(Window.partitionBy(*keys, "symbol").orderBy(time)), F.lit(0.0))))
    return rows.groupBy(*at).agg(F.sum(F.col("weight") * F.col("next_ret")).alias("gross"), F.sum(F.col("__dw") * F.col("half_spread")).alias("cost"), F.sum("__dw").alias("turnover"))


MAKER = "arm string, day int, symbol string, pnl double, spread double, adverse double, inventory double, fills double, steps long"


def market_making(df: DataFrame, scale: float = 1.0, kappa: float = 0.25, inventory_limit: float = 5.0, quote: float = 1.0, skew: float = 0.5, gate: float = 0.0, fee_bps: float = 0.0) -> DataFrame:
    """(arm, day, symbol) results of a maker that leans against inventory, with ("signal") and without ("baseline") the
    score. ``df`` has ti, day, symbol, score, scored, ret1s, spread_bps, bid_sz, ask_sz, buy_vol, sell_vol. Names are
    independent within a day, so a path is one name's day; the last score of the day so far counts. Days under 3
    rows are left out."""
    w = Window.partitionBy("symbol", "day").orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    signal = F.coalesce(F.last(F.when(F.col("scored"), finite_or("score")), ignorenulls=True).over(w), F.lit(0.0)) * scale
    clean = {c: finite_or(F.col(c).cast("double")) for c in ("bid_sz", "ask_sz", "buy_vol", "sell_vol")}
    rows = df.select("ti", "day", "symbol", signal.alias("signal"), clip(finite_or("ret1s"), -RETURN_LIMIT, RETURN_LIMIT).alias("ret"), (F.greatest(finite_or("spread_bps"), F.lit(0.0)) / 2e4).alias("half"), *[v.alias(c) for c, v in clean.items()])
    arms = rows.withColumn("arm", F.explode(F.array(F.lit("signal"), F.lit("baseline")))).withColumn("signal", F.when(F.col("arm") == "signal", F.col("signal")).otherwise(0.0))
    fee = fee_bps / 1e4

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ti", ignore_index=True)
        names = [c.split()[0] for c in MAKER.split(", ")]
        if len(pdf) < 3:
            return pd.DataFrame(columns=names)
        buys = quote * np.clip(kappa * pdf["sell_vol"] / (pdf["bid_sz"] + 1.0), 0.0, 1.0).to_numpy()
        sells = quote * np.clip(kappa * pdf["buy_vol"] / (pdf["ask_sz"] + 1.0), 0.0, 1.0).to_numpy()
        lean, ret, half = pdf["signal"].to_numpy(), pdf["ret"].to_numpy(), pdf["half"].to_numpy()
        q = pnl = spread = adverse = inventory = fills = 0.0
        for t in range(len(pdf) - 1):
            edge = lean[t] - skew * q
            bought = 0.0 if edge < -gate or q >= inventory_limit else min(buys[t], max(0.0, inventory_limit - q))
            sold = 0.0 if edge > gate or q <= -inventory_limit else min(sells[t], max(0.0, inventory_limit + q))
            q += bought - sold
            spread += half[t] * (bought + sold)
            adverse += ret[t + 1] * q
            pnl -= fee * (bought + sold)
            fills += bought + sold
            inventory += abs(q)
        pnl += spread + adverse - abs(q) * half[-1]
        return pd.DataFrame([[pdf["arm"].iloc[0], int(pdf["day"].iloc[0]), pdf["symbol"].iloc[0], pnl, spread, adverse, inventory, fills, len(pdf) - 1]], columns=names)

    return arms.groupBy("arm", "day", "symbol").applyInPandas(kernel, MAKER)


def maker_summary(paths: DataFrame) -> DataFrame:
    """(arm) metrics: Sharpe of daily profit, profit per day and name, spread capture, adverse selection, inventory and
    fills a second; fewer than 2 days give zeros."""
    names = paths.groupBy("arm").agg(F.countDistinct("symbol").alias("n_eq"))
    days = paths.groupBy("arm", "day").agg(*[F.sum(c).alias(c) for c in ("pnl", "spread", "adverse", "inventory", "fills")], F.max("steps").alias("steps"))
    out = days.groupBy("arm").agg(F.count(F.lit(1)).alias("n_days"), F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"), F.avg("spread").alias("sp"), F.avg("adverse").alias("ad"), (F.sum("inventory") / F.sum("steps")).alias("inv"), (F.sum("fills") / F.sum("steps")).alias("fi")).join(F.broadcast(names), "arm")
    values = {"sharpe": F.coalesce(safe_div("m", "s") * F.lit(DAYS_A_YEAR**0.5), F.lit(0.0)), "pnl_per_day": F.col("m"), "pnl_bps_per_name_day": F.col("m") / F.col("n_eq") * 1e4, "spread_capture": F.col("sp"), "adverse_sel": F.col("ad"), "avg_abs_inv": F.col("inv"), "fill_rate": F.col("fi")}
    return out.select("arm", "n_days", *[F.when(F.col("n_days") >= 2, v).otherwise(0.0).alias(c) for c, v in values.items()])
