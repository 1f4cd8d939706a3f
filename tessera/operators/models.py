"""Model training as Spark jobs: ridge by one pass of sums, the rest by Spark's own estimators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rounds of boosting (validation ends it earlier) and trees of a forest.
ROUNDS, TREES = 40, 40
#: name -> estimator of (features, label): the registry that users extend.
MODELS: dict[str, Callable[[], object]] = {
    "elastic_net": lambda: LinearRegression(labelCol="label", elasticNetParam=0.5, regParam=1e-4, standardization=False),
    "logistic": lambda: LogisticRegression(labelCol="label", regParam=1e-3),
    "boosted_trees": lambda: GBTRegressor(labelCol="label", maxIter=ROUNDS, maxDepth=4, stepSize=0.1, validationTol=1e-4, seed=7),
    "bagged_trees": lambda: RandomForestRegressor(labelCol="label", numTrees=TREES, maxDepth=8, seed=7),
}


def ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float, weight: str | None = None) -> tuple[list[float], float]:
    """Weighted ridge with a free intercept. All sums are one aggregate; only k * k numbers come to the driver."""
    cols = [*features, label]
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols))]
    cross = [F.sum(w * F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = df.dropna(subset=cols).agg(*sums, *cross).first()
    if not r["w"]:
        return [0.0] * len(features), 0.0
    k = len(features)
    mean = np.array([r[f"s{i}"] / r["w"] for i in range(k + 1)])
    cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] - r["w"] * mean[i] * mean[j] for j in range(k + 1)] for i in range(k + 1)])
    beta = np.linalg.solve(cov[:k, :k] + alpha * np.eye(k), cov[:k, k])
    return beta.tolist(), float(mean[k] - beta @ mean[:k])


def decay_weights(df: DataFrame, date: str = "date", half_life: float = 365.0, floor: float = 0.2, minority: str | None = None) -> DataFrame:
    """The rows with a ``weight``: half of it after every ``half_life`` days before the last date, ``floor`` at least; with a
    0/1 label ``minority``, each class also counts by how rare it is. One row of sums is broadcast."""
    top = df.agg(F.max(date).alias("__top"), *([F.avg(F.col(minority).cast("double")).alias("__share")] if minority else []))
    age = F.datediff("__top", date) / half_life
    w = F.greatest(F.pow(F.lit(0.5), age), F.lit(floor))
    if minority:
        share = F.when(F.col(minority) == 1, F.col("__share")).otherwise(1 - F.col("__share"))
        w = w * F.try_divide(F.lit(0.5), F.nullif(share, F.lit(0.0)))
    return df.crossJoin(F.broadcast(top)).withColumn("weight", w).drop("__top", "__share")


def train(df: DataFrame, features: Sequence[str], label: str, name: str, weight: str | None = None, validation: str | None = None) -> PipelineModel:
    """A fitted model of ``MODELS``; with row weights, and with a boolean column of validation rows, by which boosting ends
    where they no longer gain and which no other model is fitted on."""
    est = MODELS[name]()
    stops = validation is not None and est.hasParam("validationIndicatorCol")
    if weight:
        est = est.setWeightCol(weight)
    if stops:
        est = est.setValidationIndicatorCol(validation)
    elif validation:
        df = df.filter(~F.col(validation))
    extra = [c for c in (weight, validation if stops else None) if c]
    known = df.dropna(subset=[*features, label]).select(*features, *extra, F.col(label).cast("double").alias("label"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), est]).fit(known)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str = "pred") -> DataFrame:
    return model.transform(df.dropna(subset=list(features))).withColumnRenamed("prediction", out).drop("features", "rawPrediction", "probability")


def walk_forward(df: DataFrame, features: Sequence[str], label: str, starts: Sequence[str], alpha: float = 10.0, date: str = "date", purge_days: int = 7) -> DataFrame:
    """Predictions of every test window by a ridge fitted on what lies ``purge_days`` before it; windows are few, each fit is
    one aggregate over the cluster."""
    out = None
    for start, end in zip(starts[:-1], starts[1:], strict=True):
        beta, bias = ridge(df.filter(F.col(date) < F.date_sub(F.lit(start).cast("date"), purge_days)), features, label, alpha)
        test = df.filter((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))
        scored = test.withColumn("pred", sum((b * F.col(c) for b, c in zip(beta, features, strict=True)), F.lit(bias))).withColumn("window", F.lit(start))
        out = scored if out is None else out.unionByName(scored)
    return out
