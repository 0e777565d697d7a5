"""The order-book feature set over dense bars.

Scalars, lags and short frames are column expressions; long frames are differences of running sums; recurrences and the
rolling quantile run in one kernel a symbol-day. All share one partitioning by (symbol, date); only the
cross-sectional ranks shuffle by time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.ewm import Spec, with_ewm
from tidebook.functions.expr import clip, repaired, safe_div, sum_of
from tidebook.functions.windows import gated, lag, percentile_rank, with_long_moments

EPS = 1e-9
#: Window lengths, halflives and the names of the features, which the model's input is chosen by.
FLOW_ROWS = (5, 30, 60, 300)
VOL_ROWS = (30, 60, 180, 300, 600)
HALFLIVES = (180, 600)
BOOK = 5

POSITIVE = (
    "queue_depletion_bid", "queue_depletion_ask", "queue_replenishment_bid", "queue_replenishment_ask", "trade_size_buy", "trade_size_sell",
    "rv_60s", "bv_60s", "amihud_60s", "trade_count_buy", "trade_count_sell", "aggressor_streak_buy", "aggressor_streak_sell",
    "spread_duration", "quote_stability", "price_level_flip_count", "msg_intensity_ratio", "trade_intensity_ratio", "vol_regime_ratio",
    "absorption_30s", "absorption_60s", "absorption_300s", *(f"rvol_{w}s" for w in VOL_ROWS),
)
SIGNED = (
    "ofi_raw", "message_count_acceleration", "spread_change", "depth_slope_bid", "depth_slope_ask", "depth_curvature_bid",
    "depth_curvature_ask", "kyle_lambda_60s", *(f"cvd_{w}s" for w in VOL_ROWS), *(f"{k}_{w}s" for k in ("ofi", "mom", "tfi") for w in FLOW_ROWS),
)
BOUNDED = (
    "spread_bps", "top5_book_size", "microprice_dev_bps", "obi_L1", "obi_L5", "depth_entropy_bid", "depth_entropy_ask",
    "distance_weighted_imbalance", "cancel_burst_bid", "cancel_burst_ask", "large_trade_flag", "vpin_30s", "vpin_60s", "vpin_300s",
    "jump_ratio", "kalman_z_score_mid", "mid_dev_z300", "rank_ret_1s", "rank_ofi_z180", "rank_obi_L1", "rank_spread_bps", "rank_cvd_60s", "rank_mom_60s",
)


def _c(name: str) -> Column:
    return F.col(name)


def level(side: str, what: str, i: int) -> Column:
    return F.col(f"{side}_{what}_{i:02d}").cast("double")


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def prices(df: DataFrame) -> DataFrame:
    """mid_price, ret_bps_raw, ret_bps, spread_bps."""
    bid, ask = level("bid", "px", 0), level("ask", "px", 0)
    df = df.withColumn("mid_price", (bid + ask) / 2.0)
    df = df.withColumns({"ret_bps_raw": (safe_div("mid_price", lag("mid_price")) - 1.0) * 1e4, "spread_bps": safe_div(ask - bid, "mid_price") * 1e4})
    return df.withColumn("ret_bps", F.coalesce("ret_bps_raw", F.lit(0.0)))


def book_shape(df: DataFrame) -> DataFrame:
    """Depth, entropy, distance-weighted imbalance, slope and curvature of the first five levels."""
    total = {s: sum_of(level(s, "sz", i) for i in range(BOOK)) + EPS for s in ("bid", "ask")}
    share = {s: [level(s, "sz", i) / total[s] for i in range(BOOK)] for s in total}
    entropy = {s: sum_of(F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in share[s]) for s in share}
    near = {"bid": lambda i: _c("mid_price") - level("bid", "px", i), "ask": lambda i: level("ask", "px", i) - _c("mid_price")}
    weighted = {s: sum_of(safe_div(level(s, "sz", i), near[s](i) + 1e-5) for i in range(BOOK)) for s in near}
    sz = {s: [level(s, "sz", i) for i in range(3)] for s in total}
    px = {s: [level(s, "px", i) for i in range(2)] for s in total}
    return df.withColumns({
        "top5_book_size": total["bid"] + total["ask"],
        "depth_entropy_bid": entropy["bid"],
        "depth_entropy_ask": entropy["ask"],
        "distance_weighted_imbalance": safe_div(weighted["bid"] - weighted["ask"], weighted["bid"] + weighted["ask"] + EPS),
        "depth_slope_bid": safe_div(sz["bid"][1] - sz["bid"][0], px["bid"][0] - px["bid"][1] + 1e-5),
        "depth_slope_ask": safe_div(sz["ask"][1] - sz["ask"][0], px["ask"][1] - px["ask"][0] + 1e-5),
        "depth_curvature_bid": sz["bid"][2] - 2 * sz["bid"][1] + sz["bid"][0],
        "depth_curvature_ask": sz["ask"][2] - 2 * sz["ask"][1] + sz["ask"][0],
        "obi_L5": safe_div(total["bid"] - total["ask"], total["bid"] + total["ask"]),
    })


def microstructure(df: DataFrame) -> DataFrame:
    """Microprice, first-level imbalance, spread change and how long and how steadily quotes stand."""
    bid, ask, bsz, asz = level("bid", "px", 0), level("ask", "px", 0), level("bid", "sz", 0), level("ask", "sz", 0)
    df = df.withColumns({
        "microprice": safe_div(ask * bsz + bid * asz, bsz + asz + EPS),
        "obi_L1": safe_div(bsz - asz, bsz + asz + EPS),
        "spread_change": _c("spread_bps") - lag("spread_bps"),
        "__moved": _flag(_c("mid_price") != lag("mid_price")),
    })
    df = df.withColumns({"microprice_dev_bps": safe_div(_c("microprice") - _c("mid_price"), "mid_price") * 1e4, "__still": _flag(_c("spread_change") == 0)})
    return df.withColumns({"spread_duration": gated(F.sum, "__still", 30), "quote_stability": gated(F.stddev_samp, "mid_price", 30), "price_level_flip_count": gated(F.sum, "__moved", 30)}).drop("__moved", "__still")


def queues(df: DataFrame) -> DataFrame:
    """First-queue depletion and replenishment, message acceleration, cancel bursts."""
    out = {"message_count_acceleration": (_c("msg_count") - lag("msg_count")).cast("double")}
    for s in ("bid", "ask"):
        change = level(s, "sz", 0) - lag(level(s, "sz", 0))
        cancelled = f"size_canceled_{s}"
        out[f"queue_depletion_{s}"] = F.when(change < 0, -change).otherwise(0.0)
        out[f"queue_replenishment_{s}"] = F.when(change > 0, change).otherwise(0.0)
        out[f"cancel_burst_{s}"] = _flag(_c(cancelled) > 2 * gated(F.avg, cancelled, 30))
    return df.withColumns(out)


def level_flow(side: str, i: int, before: Column | None = None, before_size: Column | None = None) -> Column:
    """One level's signed queue event: a better price adds the new size, a worse one takes the old size, else the
    difference; null (no earlier bar) counts as 0."""
    p, s = level(side, "px", i), level(side, "sz", i)
    p0, s0 = (before, before_size) if before is not None else (lag(p), lag(s))
    better, worse = (p > p0, p < p0) if side == "bid" else (p < p0, p > p0)
    return F.coalesce(F.when(better, s).when(worse, -s0).otherwise(s - s0), F.lit(0.0))


def order_flow(df: DataFrame, levels: int = BOOK) -> DataFrame:
    """ofi_raw: level flows, bid less ask, weighted by 1 / (1 + level)."""
    return df.withColumn("ofi_raw", sum_of((level_flow("bid", i) - level_flow("ask", i)) * F.lit(1.0 / (1 + i)) for i in range(levels)))


def trades(df: DataFrame) -> DataFrame:
    """Signed and total volume, trade counts and aggressor streaks."""
    buy, sell = _c("trade_size_buy"), _c("trade_size_sell")
    df = df.withColumns({"signed_trade_size": buy - sell, "trade_volume": buy + sell, "__b": _flag(buy > 0), "__s": _flag(sell > 0), "__bs": _flag(buy > sell), "__sb": _flag(sell > buy)})
    return df.withColumns({"trade_count_buy": gated(F.sum, "__b", 60), "trade_count_sell": gated(F.sum, "__s", 60), "aggressor_streak_buy": gated(F.sum, "__bs", 15), "aggressor_streak_sell": gated(F.sum, "__sb", 15)}).drop("__b", "__s", "__bs", "__sb")


def variation(df: DataFrame) -> DataFrame:
    """Realised and bipower variation, jump ratio, illiquidity and price impact over 60 rows."""
    r, y = _c("ret_bps"), _c("signed_trade_size")
    df = df.withColumns({"__r2": r * r, "__rr": F.abs(r) * F.abs(lag("ret_bps")) * F.lit(math.pi / 2), "__il": F.abs(r) / (_c("trade_volume") + 1.0), "__xy": r * y, "__yy": y * y})
    df = df.withColumns({"rv_60s": gated(F.sum, "__r2", 60), "bv_60s": gated(F.sum, "__rr", 60), "amihud_60s": gated(F.avg, "__il", 60), "__mxy": gated(F.avg, "__xy", 60), "__mx": gated(F.avg, "ret_bps", 60), "__my": gated(F.avg, "signed_trade_size", 60), "__myy": gated(F.avg, "__yy", 60)})
    my = _c("__my")
    df = df.withColumns({"jump_ratio": safe_div(clip(_c("rv_60s") - _c("bv_60s"), low=0.0), _c("rv_60s") + EPS), "kyle_lambda_60s": safe_div(_c("__mxy") - _c("__mx") * my, _c("__myy") - my * my + EPS)})
    return df.drop("__r2", "__rr", "__il", "__xy", "__yy", "__mxy", "__mx", "__my", "__myy")


def flows(df: DataFrame) -> DataFrame:
    """Rolling sums and volatilities over many lengths, toxicity, absorption, volatility regime."""
    df = df.withColumn("__abs", F.abs("signed_trade_size"))
    wanted = [("sum", "signed_trade_size", w, f"cvd_{w}s") for w in VOL_ROWS] + [("std", "ret_bps", w, f"rvol_{w}s") for w in VOL_ROWS]
    wanted += [("sum", c, w, f"{k}_{w}s") for k, c in (("ofi", "ofi_raw"), ("mom", "ret_bps"), ("tfi", "signed_trade_size")) for w in FLOW_ROWS]
    wanted += [("sum", c, w, f"__{k}{w}") for k, c in (("a", "__abs"), ("v", "trade_volume")) for w in (30, 60, 300)]
    df = with_long_moments(df, wanted)
    out = {f"vpin_{w}s": safe_div(f"__a{w}", _c(f"__v{w}") + EPS) for w in (30, 60, 300)}
    out |= {f"absorption_{w}s": _c(f"__v{w}") / (F.abs(f"mom_{w}s") + 1.0) for w in (30, 60, 300)}
    out["vol_regime_ratio"] = safe_div("rvol_30s", _c("rvol_300s") + EPS)
    return df.withColumns(out).drop("__abs", *[f"__{k}{w}" for k in "av" for w in (30, 60, 300)])


def recurrences(df: DataFrame) -> DataFrame:
    """Everything exponentially weighted, and the large-trade flag, in one kernel a symbol-day."""
    specs = [Spec("innovation", "mid_price", 30, "kalman_z_score_mid"), Spec("innovation", "mid_price", 300, "mid_dev_z300"), Spec("quantile", "trade_volume", 180, "__q95")]
    specs += [Spec("mean", c, h, f"__{k}{h}") for k, c in (("m", "msg_count"), ("t", "trade_volume")) for h in (5, 60)]
    df = with_ewm(df, specs)
    return df.withColumns({
        "large_trade_flag": _flag(_c("trade_volume") > _c("__q95")),
        "msg_intensity_ratio": safe_div("__m5", _c("__m60") + EPS),
        "trade_intensity_ratio": safe_div("__t5", _c("__t60") + EPS),
    }).drop("__q95", "__m5", "__m60", "__t5", "__t60")


def z_scores(df: DataFrame) -> DataFrame:
    """Both halflives' clipped z-scores of every feature that is not bounded by construction."""
    return with_ewm(df, [Spec(k, c, h, f"{c}_z{h}") for h in HALFLIVES for k, names in (("z_log", POSITIVE), ("z", SIGNED)) for c in names])


def ranks(df: DataFrame) -> DataFrame:
    """Cross-sectional percentile ranks at each time; a spread over a mid-price of 0 ranks as infinite."""
    spread = F.when(_c("mid_price") == 0, (level("ask", "px", 0) - level("bid", "px", 0)) * math.inf).otherwise(_c("spread_bps"))
    wanted = (("rank_ret_1s", "ret_bps", True), ("rank_ofi_z180", "ofi_raw_z180", True), ("rank_obi_L1", "obi_L1", True), ("rank_spread_bps", spread, False), ("rank_cvd_60s", "cvd_60s_z180", True), ("rank_mom_60s", "mom_60s", True))
    return df.withColumns({name: percentile_rank(c, descending=d) for name, c, d in wanted})


def extract_features(bars: DataFrame) -> DataFrame:
    """All features of dense bars; bounded features and z-scores are repaired (null and NaN to 0)."""
    # hundreds of aliased columns make the optimizer's inferred constraints grow without end once a filter follows
    bars.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
    df = bars
    for step in (prices, book_shape, microstructure, queues, order_flow, trades, variation, flows, recurrences, z_scores, ranks):
        df = step(df)
    scores = [f"{c}_z{h}" for h in HALFLIVES for c in (*POSITIVE, *SIGNED)]
    return df.withColumns({c: repaired(c) for c in (*BOUNDED, *scores)}).drop("ret_bps_raw")


def model_columns(names: list[str], prefixes: tuple[str, ...] = ()) -> list[str]:
    """The model's inputs, chosen by name: z-scores, ranks, Kalman scores and bounded features; never a column of
    another source (prefix)."""
    own = [c for c in names if not any(c.startswith(f"{p}_") for p in prefixes)]
    plain = {c for c in BOUNDED if not c.startswith("rank_") and c != "kalman_z_score_mid"}
    return [c for c in own if c.endswith(("_z180", "_z600")) or c.startswith(("rank_", "kalman_z_score_")) or c in plain]
