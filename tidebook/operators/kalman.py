"""Time-varying regression by a Kalman filter, one sequential kernel a symbol."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.functions.ewm import weighted_mean_std


class Filter:
    """State of y = x . theta + noise, theta a random walk."""

    def __init__(self, n: int, q: float = 1e-5, r: float = 1e-3):
        self.theta, self.cov, self.q, self.r = np.zeros(n), np.eye(n), q * np.eye(n), r

    def step(self, x: np.ndarray, y: float) -> float:
        """The innovation of one observation; the state moves on."""
        innovation = y - x @ self.theta
        px = self.cov @ x
        gain = px / (x @ px + self.r)
        self.theta = self.theta + gain * innovation
        self.cov = self.cov - np.outer(gain, px) + self.q
        return float(innovation)


def innovations(y: np.ndarray, x: np.ndarray, start: Filter | None = None, q: float = 1e-5, r: float = 1e-3) -> tuple[np.ndarray, Filter]:
    """Innovations against an intercept and the columns of x; a missing value gives 0 and leaves the state alone."""
    state = start or Filter(x.shape[1] + 1, q, r)
    out = np.zeros(len(y))
    full = np.column_stack([np.ones(len(y)), x])
    for i in np.flatnonzero(~np.isnan(y) & ~np.isnan(x).any(axis=1)):
        out[i] = state.step(full[i], y[i])
    return out, state


def with_kalman(df: DataFrame, asset: str, drivers: Sequence[str], halflife: float = 60, key: str = "symbol", order: str = "ts_event", q: float = 1e-5, r: float = 1e-3) -> DataFrame:
    """Adds kalman_epsilon and kalman_z_score (epsilon over its weighted deviation, 0 where there is none). The filter
    runs through a symbol's days in order of time: a group is one symbol's history, whose state can't be split."""
    names = [f.name for f in df.schema.fields]
    schema = T.StructType([*df.schema.fields, T.StructField("kalman_epsilon", T.DoubleType()), T.StructField("kalman_z_score", T.DoubleType())])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        eps, _ = innovations(pdf[asset].to_numpy(dtype=float, na_value=np.nan), pdf[list(drivers)].to_numpy(dtype=float, na_value=np.nan), q=q, r=r)
        std = weighted_mean_std(eps, halflife)[1]
        z = np.divide(eps, std, out=np.zeros_like(eps), where=np.nan_to_num(std) > 0)
        return pdf[names].assign(kalman_epsilon=eps, kalman_z_score=z)

    return df.groupBy(key).applyInPandas(kernel, schema)
