"""Models: per-horizon regressors from Spark ML, and the graph network's forward pass with given weights.

Training the neural model and boosting with a Huber objective need libraries outside this engine; the substitutes are
Spark ML's gradient-boosted trees and Huber regression, whose numbers differ from those models'.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.expr import finite_or
from tidebook.functions.windows import demeaned


def fit_horizon(train: DataFrame, features: Sequence[str], target: str, kind: str = "trees", seed: int = 0, trees: int = 20, least_rows: int = 1000) -> PipelineModel | None:
    """A regressor of the target less its mean at each time; None with too few rows. kind: trees or huber."""
    rows = train.where(F.col(target).isNotNull()).withColumn("__y", demeaned(target)).select(*[finite_or(F.col(c).cast("double")).alias(c) for c in features], "__y")
    if rows.limit(least_rows).count() < least_rows:
        return None
    assemble = VectorAssembler(inputCols=list(features), outputCol="__x")
    if kind == "trees":
        model = GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="prediction", maxIter=trees, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.5", seed=seed)
    else:
        model = LinearRegression(featuresCol="__x", labelCol="__y", predictionCol="prediction", loss="huber", regParam=0.01, maxIter=50)
    return Pipeline(stages=[assemble, model]).fit(rows)


def predict_horizon(model: PipelineModel, test: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    clean = test.withColumns({f"__f_{c}": F.col(c) for c in features}).withColumns({c: finite_or(F.col(c).cast("double")) for c in features})
    out = model.transform(clean).withColumnRenamed("prediction", name)
    return out.withColumns({c: F.col(f"__f_{c}") for c in features}).drop("__x", *[f"__f_{c}" for c in features])


def cross_sectional_loss(df: DataFrame, predicted: str, actual: str, time: str = "ts_event", weight: float = 1.0, delta: float = 1.0) -> DataFrame:
    """One row: mean Huber loss of demeaned predictions plus half the mean negative correlation at each time."""
    rows = df.withColumns({"__p": demeaned(predicted, time), "__y": demeaned(actual, time)})
    e = F.abs(F.col("__p") - F.col("__y"))
    rows = rows.withColumn("__h", F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2)))
    per = rows.groupBy(time).agg(F.sum("__h").alias("h"), F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("__p", "__y"), F.stddev_pop("__p") * F.stddev_pop("__y")).alias("c"))
    return per.agg((F.lit(weight) * (F.sum("h") / F.sum("n") - 0.5 * F.avg(F.coalesce("c", F.lit(0.0))))).alias("loss"))


def causal_convolution(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, dilation: int) -> np.ndarray:
    """x (channels, time), kernel (out, channels, taps): each output sees only times at and before its own."""
    taps = kernel.shape[2]
    padded = np.pad(x, ((0, 0), ((taps - 1) * dilation, 0)))
    stacked = np.stack([padded[:, j * dilation : j * dilation + x.shape[1]] for j in range(taps)], axis=2)
    return np.einsum("oct,cnt->on", kernel, stacked) + bias[:, None]


def temporal_encoder(x: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The last time's state after causal convolutions of dilation 1, 2, 4, ... with rectifiers and skips."""
    for i, (kernel, bias) in enumerate(layers):
        y = np.maximum(causal_convolution(x, kernel, bias, 2**i), 0.0)
        x = y + x if y.shape == x.shape else y
    return x[:, -1]


def graph_attention(h: np.ndarray, src: np.ndarray, dst: np.ndarray, edge: np.ndarray, w_src: np.ndarray, w_dst: np.ndarray, w_edge: np.ndarray, attention: np.ndarray) -> np.ndarray:
    """One head of dynamic graph attention: weights are a softmax over a target's edges of a score of the rectified sum
    of source, target and edge projections; the output is the weighted sum of source projections."""
    left, right = h @ w_src, h @ w_dst
    z = left[src] + right[dst] + edge @ w_edge
    score = np.where(z > 0, z, 0.2 * z) @ attention
    top = np.full(len(h), -np.inf)
    np.maximum.at(top, dst, score)
    weight = np.exp(score - top[dst])
    total = np.zeros(len(h))
    np.add.at(total, dst, weight)
    out = np.zeros_like(left)
    np.add.at(out, dst, (weight / total[dst])[:, None] * left[src])
    return out
