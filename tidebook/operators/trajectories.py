"""Trajectories: windows of a feature that end at anchors, and their shape, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expr import col, safe_div


def with_trajectories(bars: DataFrame, feature: str, window: int, onset: int, keys: tuple[str, ...] = ("symbol",), order: str = "bar", anchor: str = "is_anchor") -> DataFrame:
    """One row for each anchor bar with traj: the feature over ``window`` bars ending ``onset`` (at most 0) bars from
    the anchor; null beyond the series' ends. A frame collects the window at the anchors' own rows: no join."""
    if onset > 0:
        raise ValueError("onset must not be positive: the window would see the future")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(onset - window + 1, onset)
    missing = F.lit(window) - F.size("__t")
    pad = F.array_repeat(F.lit(None).cast("double"), missing)
    early = F.col("__place") < F.lit(window - 1 - onset)
    places = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    got = bars.withColumns({"__place": places, "__t": F.collect_list(F.struct(F.col(feature).cast("double").alias("x"))).over(w)}).where(F.col(anchor))
    values = F.transform("__t", lambda e: e["x"])
    return got.withColumn("traj", F.when(early, F.concat(pad, values)).otherwise(F.concat(values, pad))).drop("__t", "__place")


def _finite(traj: Column) -> Column:
    return F.filter(traj, lambda v: v.isNotNull() & ~F.isnan(v))


def _points(traj: Column, dt: float) -> Column:
    """The finite values as (x = time, v)."""
    pairs = F.transform(traj, lambda v, i: F.struct((i.cast("double") * F.lit(dt)).alias("x"), v.alias("v")))
    return F.filter(pairs, lambda p: p["v"].isNotNull() & ~F.isnan(p["v"]))


def _moments(traj: Column, dt: float) -> Column:
    """One pass over the points: their number n, sums s1..s4 of powers of x, and v0..v2 of v times powers of x."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "s1", "s2", "s3", "s4", "v0", "v1", "v2")])

    def add(acc: Column, p: Column) -> Column:
        x, v = p["x"], p["v"]
        terms = {"n": F.lit(1.0), "s1": x, "s2": x * x, "s3": x * x * x, "s4": x * x * x * x, "v0": v, "v1": x * v, "v2": x * x * v}
        return F.struct(*[(acc[c] + t).alias(c) for c, t in terms.items()])

    return F.aggregate(_points(traj, dt), zero, add)


def _steps(traj: Column) -> Column:
    v = _finite(traj)
    rest = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, 2, rest), F.slice(v, 1, rest), lambda b, a: b - a)


def _walk(traj: Column) -> Column:
    """One pass over the steps between finite values: their number n, how many rise, their sum and path length."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "up", "net", "path")])

    def add(acc: Column, d: Column) -> Column:
        terms = {"n": F.lit(1.0), "up": F.when(d > 0, 1.0).otherwise(0.0), "net": d, "path": F.abs(d)}
        return F.struct(*[(acc[c] + t).alias(c) for c, t in terms.items()])

    return F.aggregate(_steps(traj), zero, add)


def _slope(m: Column) -> Column:
    base = m["n"] * m["s2"] - m["s1"] * m["s1"]
    return F.when((m["n"] >= 4) & (base > 1e-12), safe_div(m["n"] * m["v1"] - m["s1"] * m["v0"], base))


def _curvature(m: Column) -> Column:
    n, s1, s2, s3, s4, v0, v1, v2 = (m[c] for c in ("n", "s1", "s2", "s3", "s4", "v0", "v1", "v2"))
    # determinants of the normal equations, expanded by the first column
    a, b, c = s2 * n - s1 * s1, s3 * n - s1 * s2, s3 * s1 - s2 * s2
    whole = s4 * a - s3 * b + s2 * c
    part = v2 * a - s3 * (v1 * n - s1 * v0) + s2 * (v1 * s1 - s2 * v0)
    return F.when((n >= 5) & (F.abs(whole) >= 1e-18), safe_div(part, whole))


def _drift(w: Column, steps: Column) -> Column:
    mean = safe_div(w["net"], w["n"])
    var = safe_div(F.aggregate(steps, F.lit(0.0), lambda a, d: a + (d - mean) * (d - mean)), w["n"])
    return F.when((w["n"] >= 5) & (var > 1e-24), safe_div(F.abs(w["net"]), F.sqrt(var)))


def slope(traj: str | Column, dt: float = 0.05) -> Column:
    """Least-squares slope a second; at least 4 points."""
    return _slope(_moments(col(traj), dt))


def curvature(traj: str | Column, dt: float = 0.05) -> Column:
    """Second-degree coefficient of the least-squares parabola; at least 5 points."""
    return _curvature(_moments(col(traj), dt))


def net_change(traj: str | Column) -> Column:
    v = _finite(col(traj))
    return F.when(F.size(v) >= 2, F.try_element_at(v, F.lit(-1)) - F.try_element_at(v, F.lit(1)))


def monotonicity(traj: str | Column) -> Column:
    """Share of rising steps; at least 5 steps."""
    w = _walk(col(traj))
    return F.when(w["n"] >= 5, safe_div(w["up"], w["n"]))


def efficiency(traj: str | Column) -> Column:
    """Net move over the path's length; at least 5 steps, null for a path that never moves."""
    w = _walk(col(traj))
    return F.when((w["n"] >= 5) & (w["path"] > 0), safe_div(F.abs(w["net"]), w["path"]))


def drift_vol(traj: str | Column) -> Column:
    """Net move over the steps' population deviation; at least 5 steps that vary."""
    return _drift(_walk(col(traj)), _steps(col(traj)))


def with_descriptors(df: DataFrame, traj: str = "traj", dt: float = 0.05) -> DataFrame:
    """All six descriptors; moments and steps are columns of a projection below, so each is taken once a row."""
    m, w, d = F.col("__moments"), F.col("__walk"), F.col("__steps")
    staged = df.withColumns({"__moments": _moments(col(traj), dt), "__walk": _walk(col(traj)), "__steps": _steps(col(traj))})
    shapes = {
        "slope": _slope(m), "curvature": _curvature(m), "net_change": net_change(traj), "monotonicity": F.when(w["n"] >= 5, safe_div(w["up"], w["n"])),
        "efficiency": F.when((w["n"] >= 5) & (w["path"] > 0), safe_div(F.abs(w["net"]), w["path"])), "drift_vol": _drift(w, d),
    }
    return staged.withColumns(shapes).drop("__moments", "__walk", "__steps")
