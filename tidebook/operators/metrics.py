"""Signal metrics: rank correlation, autocorrelation-robust t-statistics, AUC, hit rate, information ratio."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expr import safe_div
from tidebook.functions.windows import average_rank


def newey_west(df: DataFrame, value: str, order: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, t): t-statistic of the mean with Bartlett weights over ``lags`` autocovariances.

    The weighted sum of all lagged products is the sum of squared sums over every window of lags + 1 places, the ones
    that overhang the ends included, over lags + 1. So a running sum and one lag of it do: the cost doesn't depend on
    the number of lags."""
    lags = max(lags, 0)
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("__x"))
    means = rows.groupBy(*by).agg(F.avg("__x").alias("__m"), F.count(F.lit(1)).alias("__n"))
    rows = rows.join(means, list(by)) if by else rows.crossJoin(F.broadcast(means))
    rows = rows.withColumn("__e", F.col("__x") - F.col("__m")).withColumn("__l", F.least(F.lit(lags), F.col("__n") - 1))
    rows = rows.withColumns({"__p": F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__i": F.row_number().over(w)})
    inside = F.col("__p") - F.coalesce(F.lag("__p", lags + 1).over(w), F.lit(0.0))
    # all deviations add up to nothing, so a window that overhangs the end is what its predecessors left
    beyond = F.when((F.col("__i") >= F.col("__n") - F.col("__l")) & (F.col("__i") < F.col("__n")), F.col("__p")).otherwise(0.0)
    rows = rows.withColumn("__w", inside * inside + beyond * beyond)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("__m").alias("mean"), (F.sum("__w") / (F.first("__l") + 1) / F.count(F.lit(1))).alias("__s"))
    t = F.when(F.col("n") < 3, F.lit(0.0)).otherwise(F.col("mean") / F.sqrt(F.greatest(F.col("__s"), F.lit(1e-18)) / F.col("n")))
    return out.withColumn("t", t).drop("__s")


def daily_rank_ic(df: DataFrame, predicted: str, actual: str, time: str = "ts_event", least_names: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, time, ic): Spearman's rank correlation at each time with at least so many names, neither side constant."""
    keys = [*by, time]
    p, y = F.col(predicted).cast("double"), F.col(actual).cast("double")
    rows = df.select(*keys, p.alias("__p"), y.alias("__y")).where(p.isNotNull() & y.isNotNull() & ~F.isnan(p) & ~F.isnan(y))
    rows = rows.withColumns({"__rp": average_rank("__p", keys), "__ry": average_rank("__y", keys)})
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.try_divide(F.covar_pop("__rp", "__ry"), F.stddev_pop("__rp") * F.stddev_pop("__ry")).alias("ic"))
    return out.where((F.col("__n") >= least_names) & F.col("ic").isNotNull() & ~F.isnan("ic")).drop("__n")


def rank_ic(df: DataFrame, predicted: str, actual: str, time: str = "ts_event", least_names: int = 5, overlap: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean_ic, t, n): mean rank correlation and its robust t-statistic; fewer than 3 times give 0, 0."""
    out = newey_west(daily_rank_ic(df, predicted, actual, time, least_names, by), "ic", time, overlap, by)
    few = F.col("n") < 3
    return out.select(*by, F.when(few, 0.0).otherwise(F.col("mean")).alias("mean_ic"), F.when(few, 0.0).otherwise(F.col("t")).alias("t"), "n")


def auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc) from average ranks; 0.5 with one class. Ranks are counted by distinct score: the window holds a row a
    score, after an aggregation."""
    per = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__n"), F.sum(positive.cast("long")).alias("__pos"))
    w = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("__rank", F.sum("__n").over(w) - (F.col("__n") - 1) / 2.0)
    out = per.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum("__pos").alias("p"), F.sum(F.col("__pos") * F.col("__rank")).alias("r"))
    neg = F.col("n") - F.col("p")
    return out.select(*by, F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * neg), F.lit(0.5)).alias("auc"))


def pair_metrics(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, pearson, mse, hit_rate, ir): pooled correlation and error, share of right signs where the actual is not
    0, and mean over deviation of the sign-traded actual."""
    p, y = F.col(predicted), F.col(actual)
    traded = F.signum(p) * y
    hits = F.avg(F.when(y != 0, (F.signum(p) == F.signum(y)).cast("double")))
    return df.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), safe_div(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y)).alias("pearson"), F.avg(F.pow(p - y, F.lit(2.0))).alias("mse"),
        F.when(F.count(F.when(y != 0, 1)) > 2, hits).otherwise(0.5).alias("hit_rate"), F.coalesce(safe_div(F.avg(traded), F.stddev_pop(traded)), F.lit(0.0)).alias("ir"),
    )


def pair_tstats(df: DataFrame, predicted: str, actual: str, lags: int, order: Sequence[str] = ("ts_event", "symbol"), by: Sequence[str] = ()) -> DataFrame:
    """(by, hit_rate_t, ir_t): robust t-statistics of the share of right signs over a half, where the actual is not 0
    (0 with at most 2 such rows), and of the sign-traded actual, over pooled rows in ``order``."""
    p, y = F.col(predicted), F.col(actual)
    rows = df.where(p.isNotNull() & y.isNotNull()).select(*by, F.struct(*order).alias("__o"), (F.signum(p) * y).alias("traded"), F.when(y != 0, (F.signum(p) == F.signum(y)).cast("double") - 0.5).alias("hit"))
    ir = newey_west(rows, "traded", "__o", lags, by).select(*by, F.col("t").alias("ir_t"))
    hit = newey_west(rows, "hit", "__o", lags, by).select(*by, F.when(F.col("n") > 2, F.col("t")).otherwise(0.0).alias("hit_rate_t"))
    both = ir.join(hit, list(by), "left") if by else ir.crossJoin(F.broadcast(hit))  # one row each
    return both.select(*by, F.coalesce("hit_rate_t", F.lit(0.0)).alias("hit_rate_t"), "ir_t")


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """(by, spearman): rank correlation within ``by``."""
    rows = df.withColumns({"__a": average_rank(a, by), "__b": average_rank(b, by)})
    return rows.groupBy(*by).agg(F.corr("__a", "__b").alias("spearman"))


def two_sided_p(r: float, n: int) -> float:
    """p-value of a correlation under Student's t with n - 2 degrees of freedom, by its incomplete beta integral."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    t, steps = abs(r) * math.sqrt((n - 2) / (1 - r * r)), 20_000
    top = math.atan2(t, math.sqrt(n - 2))
    # with tan(a) = t / sqrt(df) the density becomes cos(a) ** (df - 1)
    df = n - 2

    def area(end: float) -> float:
        h = end / steps
        f = [math.cos(i * h) ** (df - 1) for i in range(steps + 1)]
        return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    return max(0.0, 1.0 - area(top) / area(math.pi / 2))
