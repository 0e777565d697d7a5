"""Exponentially weighted statistics and rolling quantiles, one kernel call for each symbol and day.

These recurrences have no window-frame form. A group is one symbol's day, so its size doesn't grow with the data; the
kernel runs on columns already partitioned by (symbol, date) and adds no shuffle to the windows before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.functions.windows import DAY, TIME

Z_CLIP = 10.0


@dataclass(frozen=True)
class Spec:
    """One output column. kind: mean, std, z (clipped z-score), z_log (z of ln(1 + max(x, 0))), innovation (the
    clipped z of the distance from the mean), recursive_z (against the state before each value), quantile (rank-based
    over the last ``span`` rows, null until all are there)."""

    kind: str
    column: str
    span: float
    name: str
    level: float = 0.95


def weighted_mean_std(x: np.ndarray, halflife: float) -> tuple[np.ndarray, np.ndarray]:
    """Adjusted weights; a null ages the weights and takes the last value. The first deviation is 0."""
    e = pd.Series(x).ewm(halflife=halflife, adjust=True, ignore_na=False)
    mean, std = e.mean().to_numpy(), e.std(bias=False).to_numpy().copy()
    seen = np.flatnonzero(~np.isnan(x))
    if len(seen):
        std[seen[0]] = 0.0
        std[seen[0] :] = pd.Series(std[seen[0] :]).ffill().to_numpy()
    return mean, std


def recursive_z(x: np.ndarray, halflife: float, mean: float = 0.0, var: float = 0.0, started: bool = False) -> tuple[np.ndarray, tuple[float, float, bool]]:
    """z of each finite value against mean and variance before it; then both are updated. State goes in and out."""
    keep = 0.5 ** (1.0 / halflife)
    out = np.full(len(x), np.nan)
    for i in np.flatnonzero(np.isfinite(x)):
        if not started:
            mean, var, started = float(x[i]), 0.0, True
            continue
        gap = float(x[i]) - mean
        if var > 1e-12:
            out[i] = gap / var**0.5
        mean += (1.0 - keep) * gap
        var = keep * var + (1.0 - keep) * gap * gap
    return out, (mean, var, started)


def weighted_mean_std_columns(x: np.ndarray, halflife: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for a matrix without nulls, all columns at once: weighted sums are running sums of values times d**-p
    over stretches short enough for d**-p to stay in range, carried from stretch to stretch. Values are taken less
    their first, so little is lost to cancellation."""
    n, k = x.shape
    d = 0.5 ** (1.0 / halflife)
    gap = x - x[:1]
    mean, std = np.empty_like(gap), np.empty_like(gap)
    c0, c1, c2, cv = 0.0, np.zeros(k), np.zeros(k), 0.0
    step = max(1, int(400 * halflife))
    for a in range(0, n, step):
        g = gap[a : a + step]
        fall = d ** np.arange(len(g))
        rise = 1.0 / fall
        s0 = fall * (np.cumsum(rise) + d * c0)
        v = fall**2 * (np.cumsum(rise**2) + d * d * cv)
        s1 = fall[:, None] * (np.cumsum(g * rise[:, None], axis=0) + d * c1)
        s2 = fall[:, None] * (np.cumsum(g * g * rise[:, None], axis=0) + d * c2)
        c0, cv, c1, c2 = s0[-1], v[-1], s1[-1], s2[-1]
        m = s1 / s0[:, None]
        room = s0**2 - v
        scale = np.divide(s0**2, room, out=np.zeros_like(s0), where=room > 1e-12 * s0**2)
        mean[a : a + step] = x[:1] + m
        std[a : a + step] = np.sqrt(np.maximum((s2 / s0[:, None] - m * m) * scale[:, None], 0.0))
    return mean, std


def z_columns(x: np.ndarray, halflife: float) -> np.ndarray:
    mean, std = weighted_mean_std_columns(x, halflife)
    return np.clip((x - mean) / (std + 1e-9), -Z_CLIP, Z_CLIP)


def evaluate(pdf: pd.DataFrame, spec: Spec) -> np.ndarray:
    x = pdf[spec.column].to_numpy(dtype=float, na_value=np.nan)
    if spec.kind == "mean":
        return weighted_mean_std(x, spec.span)[0]
    if spec.kind == "std":
        return weighted_mean_std(x, spec.span)[1]
    if spec.kind == "innovation":
        gap = x - weighted_mean_std(x, spec.span)[0]
        return np.clip(gap / (weighted_mean_std(gap, spec.span)[1] + 1e-9), -Z_CLIP, Z_CLIP)
    if spec.kind == "recursive_z":
        return recursive_z(x, spec.span)[0]
    if spec.kind == "quantile":
        return pd.Series(x).rolling(int(spec.span)).quantile(spec.level, interpolation="nearest").to_numpy()
    raise ValueError(f"unknown kind {spec.kind}")


def with_ewm(df: DataFrame, specs: Sequence[Spec], keys: Sequence[str] = DAY, order: str = TIME) -> DataFrame:
    """Adds a double column for each spec; NaN becomes null. Rows without a group key form a group like any other."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(s.name, T.DoubleType()) for s in specs]])
    names = [f.name for f in df.schema.fields]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        extra = {}
        scored = [s for s in specs if s.kind in ("z", "z_log")]
        if scored:
            base = {(s.column, s.kind): np.nan_to_num(pdf[s.column].to_numpy(dtype=float, na_value=np.nan), nan=0.0) for s in scored}
            base = {k: np.log(np.maximum(v, 0.0) + 1.0) if k[1] == "z_log" else v for k, v in base.items()}
            for span in dict.fromkeys(s.span for s in scored):
                mine = [s for s in scored if s.span == span]
                z = z_columns(np.column_stack([base[s.column, s.kind] for s in mine]), span)
                extra |= {s.name: z[:, i] for i, s in enumerate(mine)}
        for s in specs:
            if s.name in extra:
                continue
            extra[s.name] = evaluate(pdf.assign(**extra) if s.column in extra else pdf, s)
        return pd.concat([pdf[names], pd.DataFrame({s.name: extra[s.name] for s in specs}, index=pdf.index)], axis=1)

    return df.groupBy(*keys).applyInPandas(kernel, schema)
