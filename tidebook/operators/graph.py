"""Dynamic correlation graphs: pair statistics by window, relations, top-k pruning, edges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expr import clip, finite_or, safe_div

#: The relation numbers.
SELF, MACRO, POS, NEG, LEADLAG, SECTOR, MARKET = range(7)
ATTRIBUTES = ("corr", "abs_corr", "beta_5m", "beta_30m", "lead_lag_5s", "lead_lag_30s", "vol_ratio", "spread_z", "liq_ratio", "res_z", "macro_leadlag")


def window_ends(panel: DataFrame, back: Sequence[int], step: int = 1, first: int = 1) -> DataFrame:
    """(te, lo_<back>): every ``step``-th row index as a window end, with each lookback clipped at its day's start.
    ``panel`` has (ti, day)."""
    days = panel.groupBy("day").agg(F.min("ti").alias("ds"))
    ends = panel.select("ti", "day").distinct().where((F.col("ti") >= first) & (F.col("ti") % step == 0)).join(F.broadcast(days), "day")
    return ends.select(F.col("ti").alias("te"), *[F.greatest("ds", F.col("ti") - n).alias(f"lo_{n}") for n in back])


def pair_stats(panel: DataFrame, ends: DataFrame, low: str, lag: int, prefix: str) -> DataFrame:
    """(te, i, j, {prefix}corr, beta, vol_ratio, ll) over rows low..te of ``panel`` (ti, node, ret).

    Covariances divide by n - 1 and deviations by n. A row takes part in the windows that cover it (equi-join on
    coarse blocks of ti, then the exact bounds); pairs meet at equal times, so nodes pair only within one row's time."""
    block = 512
    near = ends.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / block), F.floor(F.col("te") / block))))
    rows = panel.select("ti", "node", "ret").withColumn("__b", F.floor(F.col("ti") / block)).join(near.select("te", low, "__b"), "__b")
    rows = rows.where((F.col("ti") >= F.col(low)) & (F.col("ti") <= F.col("te"))).select("te", "ti", "node", "ret", low)

    def meet(other: DataFrame, later: int) -> DataFrame:
        b = other.select(F.col("te").alias("te2"), (F.col("ti") + later).alias("ti2"), F.col("node").alias("j"), F.col("ret").alias("y"))
        return rows.join(b, (F.col("te") == F.col("te2")) & (F.col("ti") == F.col("ti2"))).select("te", F.col("node").alias("i"), "j", F.col("ret").alias("x"), "y")

    now = meet(rows, 0).groupBy("te", "i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.var_pop("x").alias("vi"), F.var_pop("y").alias("vj"), F.count(F.lit(1)).alias("n"))
    tiny = 1e-12
    vi, vj = (F.when(F.col(v) > 0, F.col(v)).otherwise(tiny) for v in ("vi", "vj"))
    cov = F.coalesce("cov", F.lit(0.0))
    now = now.select("te", "i", "j", "n", F.coalesce(safe_div(cov, F.sqrt(vi) * F.sqrt(vj)), F.lit(0.0)).alias(f"{prefix}corr"), clip(cov / vj, -5.0, 5.0).alias(f"{prefix}beta"), F.ln((F.sqrt(vi) + 1e-12) / (F.sqrt(vj) + 1e-12)).alias(f"{prefix}vol_ratio"))
    late = meet(rows, lag).groupBy("te", "i", "j").agg(F.covar_samp("x", "y").alias("c"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("d"), F.count(F.lit(1)).alias("m"))
    late = late.select("te", "i", "j", F.when((F.col("m") >= 2) & (F.col("d") > 0), F.col("c") / F.col("d")).otherwise(0.0).alias("__ll"), "m")
    out = now.join(late, ["te", "i", "j"], "left")
    return out.select("te", "i", "j", "n", f"{prefix}corr", f"{prefix}beta", f"{prefix}vol_ratio", F.when(F.col("m") >= 2, F.coalesce("__ll", F.lit(0.0))).otherwise(0.0).alias(f"{prefix}ll"))


def whole_windows(panel: DataFrame, seq: int = 1) -> DataFrame:
    """(te): the row indices that end a window: the last ``seq`` rows lie in the day, and some row there is ``valid``
    where ``panel`` (ti, day) has that column."""
    valid = F.coalesce("valid", F.lit(False)) if "valid" in panel.columns else F.lit(True)
    times = panel.groupBy("ti", "day").agg(F.max(valid).alias("valid"))
    days = times.groupBy("day").agg(F.min("ti").alias("ds"))
    return times.join(F.broadcast(days), "day").where((F.col("ti") - F.col("ds") >= seq - 1) & F.col("valid")).select(F.col("ti").cast("long").alias("te"))


def self_loops(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node's edge to itself at every window end, its attributes 0."""
    loops = ends.select("te").crossJoin(F.broadcast(nodes.select("node").distinct()))
    return loops.select("te", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(SELF).alias("rel"), *[F.lit(0.0).alias(a) for a in ATTRIBUTES])


def every_end_stats(panel: DataFrame, back: int, lag: int, prefix: str, seq: int = 1, block: int = 512) -> DataFrame:
    """``pair_stats`` of every row index as a window end that ``whole_windows`` lists; lookbacks of ``back`` rows are
    clipped at the day's start. ``panel`` (ti, day, node, ret, valid if any) has every node at every time.

    A row goes to each block of ends that its windows reach, and a kernel takes one block of a day: at most
    ``back + block`` times, however long the day or the table."""
    days = panel.groupBy("day").agg(F.min("ti").alias("ds"), F.max("ti").alias("de"))
    reach = F.sequence(F.floor(F.col("ti") / block), F.floor(F.least(F.col("ti") + back, "de") / block))
    valid = F.coalesce("valid", F.lit(False)) if "valid" in panel.columns else F.lit(True)
    rows = panel.join(F.broadcast(days), "day").select("day", "ds", F.explode(reach).alias("__b"), F.col("ti").cast("long").alias("ti"), "node", F.col("ret").cast("double").alias("ret"), valid.alias("valid"))
    names = ["n", *[prefix + c for c in ("corr", "beta", "vol_ratio", "ll")]]

    def stats(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot(index="ti", columns="node", values="ret")
        ti, nodes, r, start = wide.index.to_numpy(), wide.columns.to_numpy(), wide.to_numpy(), int(part["ds"].iloc[0])
        ends = ti[(ti // block == key[1]) & (ti - start >= seq - 1) & np.isin(ti, part["ti"][part["valid"]])]
        got = [_window_stats(r[np.searchsorted(ti, max(start, te - back)) : np.searchsorted(ti, te) + 1], lag) for te in ends]
        size = len(nodes) ** 2
        out = {"te": np.repeat(ends, size), "i": np.tile(np.repeat(nodes, len(nodes)), len(ends)), "j": np.tile(nodes, len(nodes) * len(ends))}
        return pd.DataFrame(out | {c: np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k, c in enumerate(names)})

    schema = f"te long, i string, j string, n long, {', '.join(f'{c} double' for c in names[1:])}"
    return rows.groupBy("day", "__b").applyInPandas(stats, schema)


def _centred(r: np.ndarray) -> np.ndarray:
    """Columns less their means; exactly 0 where a column never varies."""
    return np.where(r.max(axis=0) > r.min(axis=0), r - r.mean(axis=0), 0.0)


def _window_stats(r: np.ndarray, lag: int) -> tuple[np.ndarray, ...]:
    """n, corr, beta, vol_ratio and ll of all column pairs (i, j) of one window, flat, by ``pair_stats``' rules."""
    n, k = r.shape
    c = _centred(r)
    var = (c * c).mean(axis=0)
    var = np.where(var > 0, var, 1e-12)
    sd = np.sqrt(var)
    cov = c.T @ c / max(n - 1, 1)
    ll = np.zeros((k, k))
    if n - lag >= 2:
        x, y = _centred(r[lag:]), _centred(r[:-lag])
        d = np.outer(np.sqrt((x * x).mean(axis=0)), np.sqrt((y * y).mean(axis=0)))
        ll = np.divide(x.T @ y / (n - lag - 1), d, out=ll, where=d > 0)
    ratio = np.log((sd[:, None] + 1e-12) / (sd[None, :] + 1e-12))
    return tuple(x.ravel() for x in (np.full(k * k, n), cov / np.outer(sd, sd), np.clip(cov / var[None, :], -5.0, 5.0), ratio, ll))


def relation(threshold: float, sector: Column, market: Column, macro: Column) -> Column:
    """The relation of target i and source j: of all that hold, the one of the highest standing."""
    corr, ll = F.col("corr"), F.col("lead_lag_5s")
    strong = macro & ((F.abs(corr) >= threshold / 2) | (F.abs(ll) >= threshold / 2))
    return (
        F.when(F.col("i") == F.col("j"), SELF).when(strong, MACRO).when(market, MARKET).when(sector, SECTOR)
        .when(F.abs(ll) >= max(0.08, threshold / 2), LEADLAG).when(corr <= -threshold, NEG).when(corr >= threshold, POS)
    )


def prune(edges: DataFrame, k: int) -> DataFrame:
    """Of each target's correlation and lead-lag edges keep the k strongest (ties: smaller source); others all stay."""
    dense = F.col("rel").isin(POS, NEG, LEADLAG)
    strength = F.greatest(F.abs("corr"), F.abs("lead_lag_5s"))
    w = Window.partitionBy("te", "i", dense).orderBy(strength.desc(), "j")
    return edges.withColumn("__r", F.row_number().over(w)).where(~dense | (F.col("__r") <= k)).drop("__r")


def dynamic_edges(panel: DataFrame, nodes: DataFrame, ends: DataFrame | None, threshold: float = 0.2, top_k: int = 8, market: str | None = None, lag: int = 5, slow_lag: int = 30, short: str = "lo_300", long: str = "lo_1800", ablate: bool = False, seq: int = 1) -> DataFrame:
    """(te, src, dst, rel, attributes) for each window end; without ``ends`` for every one that ``whole_windows`` lists.

    panel: (ti, node, ret), and day without ``ends``; nodes: (node, kind "equity" or "macro", sector) and, joined by node and te where given,
    spread, liquidity and residual. Without ``long`` rows over 30 the slow statistics are the fast ones. ``ablate``
    gives ``self_loops`` alone, and so has a window without rows."""
    if ablate:
        return self_loops(whole_windows(panel, seq) if ends is None else ends, nodes)

    def stats(low: str, later: int, prefix: str) -> DataFrame:
        return every_end_stats(panel, int(low.removeprefix("lo_")), later, prefix, seq) if ends is None else pair_stats(panel, ends, low, later, prefix)

    fast = stats(short, lag, "").withColumnRenamed("ll", "lead_lag_5s").withColumnRenamed("beta", "beta_5m")
    slow = stats(long, slow_lag, "slow_").select("te", "i", "j", F.col("n").alias("slow_n"), "slow_beta", "slow_ll")
    pairs = fast.join(slow, ["te", "i", "j"], "left")
    enough = F.col("slow_n") > 30
    pairs = pairs.withColumns({"beta_30m": F.when(enough, F.col("slow_beta")).otherwise(F.col("beta_5m")), "lead_lag_30s": F.when(enough, F.col("slow_ll")).otherwise(F.col("lead_lag_5s"))})
    few = [c for c in ("spread", "liquidity", "residual") if c in nodes.columns]
    for side in ("i", "j"):
        named = nodes.select(F.col("node").alias(side), *([F.col("te")] if "te" in nodes.columns else []), F.col("kind").alias(f"kind_{side}"), F.col("sector").alias(f"sector_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in few])
        pairs = pairs.join(F.broadcast(named) if "te" not in nodes.columns else named, [side, *(["te"] if "te" in nodes.columns else [])])

    def ratio(c: str) -> Column:
        if c not in few:
            return F.lit(0.0)
        a, b = (F.greatest(F.coalesce(F.col(f"{c}_{s}"), F.lit(0.0)), F.lit(0.0)) + 1e-9 for s in ("i", "j"))
        return F.ln(a / b)

    equity_i = F.col("kind_i") == "equity"
    sector = equity_i & (F.col("kind_j") == "equity") & (F.col("sector_i") == F.col("sector_j")) & (F.col("i") != F.col("j"))
    of_market = (F.col("j") == F.lit(market)) & equity_i & (F.col("i") != F.col("j")) if market is not None else F.lit(False)
    macro = equity_i & (F.col("kind_j") == "macro")
    rel = relation(threshold, F.coalesce(sector, F.lit(False)), of_market, macro)
    pairs = pairs.withColumns({"rel": rel, "abs_corr": F.abs("corr"), "spread_z": ratio("spread"), "liq_ratio": ratio("liquidity"), "res_z": (F.col("residual_i") - F.col("residual_j")) if "residual" in few else F.lit(0.0), "macro_leadlag": F.col("lead_lag_5s")})
    edges = prune(pairs.where(F.col("rel").isNotNull()), top_k) if top_k else pairs.where(F.col("rel").isNotNull())
    edges = edges.select("te", F.col("j").alias("src"), F.col("i").alias("dst"), "rel", *[finite_or(F.col(a).cast("double"), 0.0, 10.0, -10.0).alias(a) for a in ATTRIBUTES])
    if ends is None:
        return edges
    # a window that covers none of the panel's rows
    return edges.unionByName(self_loops(ends.join(panel.select(F.col("ti").alias("te")).distinct(), "te", "left_anti"), nodes))


def sector_pairs(nodes: DataFrame, sector: str = "sector", node: str = "node") -> DataFrame:
    """(src, dst) of different nodes of one sector."""
    a, b = nodes.select(F.col(sector).alias("s"), F.col(node).alias("src")), nodes.select(F.col(sector).alias("s2"), F.col(node).alias("dst"))
    return a.join(b, (F.col("s") == F.col("s2")) & (F.col("src") != F.col("dst"))).select("src", "dst")


def batch_offsets(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Block-diagonal batching: the b-th graph's node numbers move by b * n_nodes. ``edges`` has (te, src, dst)."""
    order = edges.select("te").distinct().withColumn("__b", F.dense_rank().over(Window.orderBy("te")) - 1)  # a row a graph of one batch
    both = edges.join(order, "te")
    return both.withColumns({"src": F.col("src") + F.col("__b") * n_nodes, "dst": F.col("dst") + F.col("__b") * n_nodes}).drop("__b")
