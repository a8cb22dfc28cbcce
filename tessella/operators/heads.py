"""Logistic heads and probability arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Shares of exp(score), shifted by the largest."""
    shifted = lambda s: _bound(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp(v - top)))
    return _shares(_bound(scores, shifted))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value made once a row instead of once for each element that looks at it."""
    return F.transform(F.array(value), use)[0]


def _shares(weights: Column) -> Column:
    of = lambda w: _bound(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(w, lambda v: v / total))
    return _bound(weights, of)


def prior_corrected(p: Column, prior: Sequence[float], exponent: float) -> Column:
    """p times prior ** exponent, class by class, renormalised."""
    return _shares(F.zip_with(p, F.array(*(F.lit(float(v) ** exponent) for v in prior)), lambda a, b: a * b))


def fit_logistic(tok: DataFrame, C: float, features: str = "feat", label: str = "class_id", iterations: int = 200) -> tuple[LogisticRegressionModel, list[int]]:
    """L2 logistic regression that minimises C * sum(w * loss) + |coef|^2 / 2 under balanced weights n / (k * n_c).

    MLlib divides the loss by the sum of weights, hence the penalty 1 / (C * sum of weights); balanced weights add up to n.
    """
    counts = {r[0]: r[1] for r in tok.groupBy(label).count().collect()}
    classes, n = sorted(counts), sum(counts.values())
    weight = F.element_at(F.create_map(*(F.lit(v) for c in classes for v in (c, n / (len(classes) * counts[c])))), F.col(label))
    rows = tok.select(array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("features"), (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double").alias("label"), weight.alias("w"))
    return LogisticRegression(regParam=1 / (C * n), elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=iterations, tol=1e-9).fit(rows), classes


def predict_logistic(tok: DataFrame, fitted: tuple[LogisticRegressionModel, list[int]], features: str = "feat") -> DataFrame:
    model, classes = fitted
    rows = tok.withColumn("features", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    out = model.transform(rows).withColumn("pred", F.element_at(F.array(*map(F.lit, classes)), (F.col("prediction") + 1).cast("int")))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def fit_numeric(tok: DataFrame, C: float = 0.1, features: str = "feat", label: str = "class_id") -> dict[str, list]:
    """A scaler (population standard deviation, 1 for a constant channel) and a balanced logistic head on it, as plain numbers.

    Three groups 1, 2 and 3 are expected. The moments are sums by channel, made on the executors.
    """
    per = tok.select(F.posexplode(features).alias("ch", "v")).groupBy("ch").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("ch").collect()  # a row a channel
    mean, scale = [float(r.m) for r in per], [float(r.s) or 1.0 for r in per]
    rows = tok.withColumn(features, scaled(features, mean, scale))
    model, classes = fit_logistic(rows, C, features, label)
    if classes != [1, 2, 3]:
        raise ValueError("three groups 1, 2, 3 are expected")
    return {"scaler_mean": mean, "scaler_scale": scale, "logistic_coef": model.coefficientMatrix.toArray().tolist(), "logistic_intercept": list(model.interceptVector.toArray()), "class_ids": classes}


def scaled(features: str, mean: Sequence[float], scale: Sequence[float]) -> Column:
    """(feature - mean) / scale, channel by channel."""
    both = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, scale, strict=True)))
    return F.zip_with(features, both, lambda v, q: (v.cast("double") - q["m"]) / q["s"])


def numeric_probabilities(tok: DataFrame, head: dict[str, list], features: str = "feat") -> DataFrame:
    """tok with the head's class probabilities as an array."""
    x = scaled(features, head["scaler_mean"], head["scaler_scale"])
    dots = F.array(*(F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in row)), lambda a, b: a * b), F.lit(float(b)), lambda s, v: s + v) for row, b in zip(head["logistic_coef"], head["logistic_intercept"], strict=True)))
    return tok.withColumn("p", softmax(dots))
