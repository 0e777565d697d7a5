"""Order-book formulas for fine grids: columns that guard their divisors with null where a value has no meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.ewm import Spec, with_ewm
from tidebook.functions.expr import col, safe_div, sum_of
from tidebook.functions.windows import gated, lag, shifted

BARS_PER_SECOND = 20
C = str | Column


def _where(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def mid(bid: C, ask: C) -> Column:
    return (col(bid) + col(ask)) / F.lit(2.0)


def spread_bps(bid: C, ask: C) -> Column:
    m = mid(bid, ask)
    return _where(m > 0, safe_div(col(ask) - col(bid), m) * 1e4)


def microprice(bid: C, ask: C, bid_size: C, ask_size: C) -> Column:
    """Size-weighted price; the mid where there is no size."""
    total = col(bid_size) + col(ask_size)
    return F.when(total > 0, safe_div(col(ask) * col(bid_size) + col(bid) * col(ask_size), total)).otherwise(mid(bid, ask))


def microprice_dev_bps(bid: C, ask: C, bid_size: C, ask_size: C) -> Column:
    m = mid(bid, ask)
    return _where(m > 0, safe_div(microprice(bid, ask, bid_size, ask_size) - m, m) * 1e4)


def obi_level(bid_size: C, ask_size: C) -> Column:
    total = col(bid_size) + col(ask_size)
    return _where(total > 0, safe_div(col(bid_size) - col(ask_size), total))


def depth_ratio(size: C, first: C) -> Column:
    return _where(col(first) > 0, safe_div(size, first))


def log_return_bps(price: C, w=None) -> Column:
    """First row 0; null where a price is not positive."""
    x = F.when(col(price) > 0, F.ln(col(price)))
    before = lag(F.struct(x.alias("x")), 1, w)
    return F.when(before.isNull(), F.lit(0.0)).otherwise((x - before["x"]) * 1e4)


def top_book_size(bid_sizes: Sequence[C], ask_sizes: Sequence[C], levels: int) -> Column:
    if min(len(bid_sizes), len(ask_sizes)) < levels:
        raise ValueError(f"fewer than {levels} levels")
    return sum_of([*bid_sizes[:levels], *ask_sizes[:levels]])


def order_flow(levels: Sequence[tuple[C, C, C, C]], w=None) -> Column:
    """Multi-level order flow from (bid price, bid size, ask price, ask size); a day's first row meets itself."""
    out = F.lit(0.0)
    for i, (bp, bs, ap, as_) in enumerate(levels):
        bp0, bs0, ap0, as0 = (shifted(x, 1, w) for x in (bp, bs, ap, as_))
        bid = F.when(col(bp) > bp0, col(bs)).when(col(bp) < bp0, -bs0).otherwise(col(bs) - bs0)
        ask = F.when(col(ap) < ap0, col(as_)).when(col(ap) > ap0, -as0).otherwise(col(as_) - as0)
        out = out + (F.coalesce(bid, F.lit(0.0)) - F.coalesce(ask, F.lit(0.0))) * F.lit(1.0 / (1 + i))
    return out


def cvd(signed: C, seconds: int, per_second: int = BARS_PER_SECOND, w=None) -> Column:
    return gated(F.sum, signed, seconds * per_second, 1, w)


def net_book_pressure(bid_add: C, bid_remove: C, ask_add: C, ask_remove: C) -> Column:
    return (col(ask_remove) + col(bid_add)) - (col(bid_remove) + col(ask_add))


def bid_share(bid: C, ask: C, fallback: float = 0.5) -> Column:
    return F.coalesce(safe_div(bid, col(bid) + col(ask)), F.lit(fallback))


def absorption(volume: C, ret: C, seconds: int, side: str, per_second: int = BARS_PER_SECOND, w=None) -> Column:
    """Volume over the sum of moves toward one side ("buy": up, "sell": down); null where there were none."""
    if side not in ("buy", "sell"):
        raise ValueError("side is buy or sell")
    toward = F.greatest(col(ret) if side == "buy" else -col(ret), F.lit(0.0))
    n = seconds * per_second
    moves = gated(F.sum, toward, n, 1, w)
    return _where(moves > 1e-9, safe_div(gated(F.sum, volume, n, 1, w), moves))


def realized_vol(ret: C, seconds: int, per_second: int = BARS_PER_SECOND, w=None) -> Column:
    n = seconds * per_second
    return gated(F.stddev_samp, ret, n, max(20, n // 4), w)


def vol_expansion(short: C, long: C) -> Column:
    return safe_div(short, col(long) + F.lit(1e-12))


def trade_side_share(buy: C, sell: C, seconds: int, per_second: int = BARS_PER_SECOND, w=None) -> Column:
    n = seconds * per_second
    b, s = gated(F.sum, buy, n, 1, w), gated(F.sum, sell, n, 1, w)
    return F.coalesce(safe_div(b, b + s), F.lit(0.5))


def with_variance_ratio(df: DataFrame, price: str, k: int, seconds: int, name: str, per_second: int = BARS_PER_SECOND) -> DataFrame:
    """Variance of k-bar over k times that of 1-bar log returns; null where the latter is 0."""
    n = seconds * per_second
    x = F.when(F.col(price) > 0, F.ln(price))
    df = df.withColumn("__x", x)
    df = df.withColumns({"__1": F.col("__x") - lag("__x"), "__k": F.col("__x") - lag("__x", k)})
    df = df.withColumns({"__v1": gated(F.var_samp, "__1", n, max(20, n // 4)), "__vk": gated(F.var_samp, "__k", n, max(4 * k, n // 4))})
    return df.withColumn(name, _where(F.col("__v1") > 0, F.col("__vk") / (F.lit(float(k)) * F.col("__v1") + 1e-30))).drop("__x", "__1", "__k", "__v1", "__vk")


#: Base feature, whether ln(1 + x) comes first, whether the sign is kept.
Z_FEATURES = (
    ("top5_book_size", True, False), ("top10_book_size", True, False), ("quote_update_count", True, False), ("ofi_raw", False, True),
    ("buy_volume_per_bar", True, False), ("sell_volume_per_bar", True, False), ("cvd_30s", False, True), ("cvd_60s", False, True), ("cvd_180s", False, True),
    ("bid_add_rate", True, False), ("ask_add_rate", True, False), ("bid_remove_rate", True, False), ("ask_remove_rate", True, False), ("net_book_pressure", False, True),
    ("buy_absorption_30s", True, False), ("buy_absorption_180s", True, False), ("buy_absorption_600s", True, False),
    ("sell_absorption_30s", True, False), ("sell_absorption_180s", True, False), ("sell_absorption_600s", True, False),
    ("rvol_5s", True, False), ("rvol_30s", True, False), ("vr_k5_w60s", True, False), ("vr_k15_w180s", True, False),
)


def z_sweep(df: DataFrame, column: str, signed: bool, log1p: bool, halflives: Sequence[float], keys: Sequence[str] = ("symbol",), order: str = "ts_event") -> DataFrame:
    """Adds {column}_z{halflife}: each value's z against mean and variance before it. A signed feature is scored as it
    is; ln(1 + x) of a signed one has no meaning and is refused. State runs through ``keys``: a symbol by default."""
    if signed and log1p:
        raise ValueError("a signed feature can't go through log1p")
    x = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("__x", F.log1p(F.greatest(x, F.lit(0.0))) if log1p else x)
    return with_ewm(df, [Spec("recursive_z", "__x", h, f"{column}_z{h:g}") for h in halflives], keys, order).drop("__x")
