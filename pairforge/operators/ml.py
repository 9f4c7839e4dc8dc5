"""Fitting, scoring and calibrating pair scorers.

Fits read their input by aggregates: each Newton step is one pass that sums gradient and Hessian in the JVM, and only
these sums, whose size is the square of the number of features, reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.numeric import logit, sigmoid


@dataclass
class Scorer:
    """A fitted logistic scorer: standardisation, intercept and coefficients."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    intercept: float = 0.0
    coefficients: list[float] = field(default_factory=list)
    steps: int = 0

    def standardised(self) -> list[Column]:
        """Features less their mean by their scale; missing ones count as the mean."""
        return [(F.coalesce(F.col(f).cast("double"), F.lit(m)) - m) / s for f, m, s in zip(self.features, self.mean, self.scale, strict=True)]

    def margin(self, offset: Column | None = None) -> Column:
        total = F.lit(self.intercept) if offset is None else offset + self.intercept
        for x, c in zip(self.standardised(), self.coefficients, strict=True):
            total = total + x * c
        return total

    def probability(self, offset: Column | None = None) -> Column:
        return sigmoid(self.margin(offset))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Scorer:
        return cls(**json.loads(text))


def standardise(df: DataFrame, features: Sequence[str]) -> Scorer:
    """Means and population deviations of the present values, after missing ones became the mean; no spread gives 1."""
    sums = df.agg(F.count("*").alias("rows"), *(F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features), *(F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features), *(F.count(f).alias(f"n_{f}") for f in features)).first()
    mean = [sums[f"m_{f}"] or 0.0 for f in features]
    spread = [((sums[f"v_{f}"] or 0.0) * (sums[f"n_{f}"] / max(sums["rows"], 1))) ** 0.5 for f in features]
    return Scorer(list(features), mean, [s if s > 1e-12 else 1.0 for s in spread], 0.0, [0.0] * len(features))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows weighted by rows / (2 rows of their label); counts come from one aggregate of a row for each label."""
    counts = df.groupBy(F.col(label).alias("_y")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return df.join(F.broadcast(counts.join(total, F.lit(True))), F.col(label) == F.col("_y")).withColumn(out, F.col("_all") / (2 * F.col("_n"))).drop("_y", "_n", "_all")


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, *, l2: float = 1.0, weight: str | None = None, offset: str | None = None, most_steps: int = 100, tolerance: float = 1e-8) -> Scorer:
    """Newton's method for a logistic model with ridge penalty on all but the intercept, and an optional offset."""
    model = standardise(df, features)
    k = len(model.features) + 1
    y, w = F.col(label).cast("double"), F.col(weight) if weight else F.lit(1.0)
    base = F.col(offset) if offset else None
    theta = np.zeros(k)
    for step in range(1, most_steps + 1):
        model.intercept, model.coefficients = float(theta[0]), [float(x) for x in theta[1:]]
        xs = [F.lit(1.0), *model.standardised()]
        names = [f"_x{i}" for i in range(k)]
        rows = df.select(y.alias("_y"), w.alias("_w"), model.probability(base).alias("_p"), *(x.alias(n) for x, n in zip(xs, names, strict=True)))
        slope = F.col("_w") * (F.col("_p") - F.col("_y"))
        curve = F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = rows.agg(*(F.sum(slope * F.col(n)).alias(f"g{i}") for i, n in enumerate(names)), *(F.sum(curve * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs)).first()
        grad = np.array([sums[f"g{i}"] or 0.0 for i in range(k)])
        hess = np.zeros((k, k))
        for i, j in pairs:
            hess[i, j] = hess[j, i] = sums[f"h{i}_{j}"] or 0.0
        ridge = np.diag([0.0] + [l2] * (k - 1))
        move = np.clip(np.linalg.solve(hess + ridge + 1e-12 * np.eye(k), grad + ridge @ theta), -5, 5)
        theta = theta - move
        model.steps = step
        if np.linalg.norm(move) <= tolerance:
            break
    model.intercept, model.coefficients = float(theta[0]), [float(x) for x in theta[1:]]
    return model


def top_coefficients(model: Scorer, k: int = 10) -> list[tuple[str, float]]:
    return sorted(zip(model.features, model.coefficients, strict=True), key=lambda x: (-abs(x[1]), x[0]))[:k]


@dataclass
class Calibration:
    """Platt scaling: a probability's logit times scale plus bias."""

    scale: float = 1.0
    bias: float = 0.0
    eps: float = 1e-6

    def apply(self, p: Column) -> Column:
        return sigmoid(logit(p, self.eps) * self.scale + self.bias)


def fit_platt(df: DataFrame, probability: str, label: str, *, l2: float = 1e-3, most_steps: int = 100, tolerance: float = 1e-8, eps: float = 1e-6) -> Calibration:
    """Fits scale and bias to smoothed targets; a step that raises the loss is halved. One pass for each try."""
    counts = df.agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").alias("n")).first()
    pos, neg = counts["p"] or 0.0, counts["n"] - (counts["p"] or 0.0)
    if not counts["n"]:
        return Calibration(eps=eps)
    target = F.when(F.col(label).cast("int") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    rows = df.select(logit(F.col(probability), eps).alias("z"), target.alias("t"))

    def look(a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        p = sigmoid(F.col("z") * a + b)
        inside = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        d, c, z = p - F.col("t"), p * (1 - p), F.col("z")
        s = rows.agg(F.sum(-(F.col("t") * F.log(inside) + (1 - F.col("t")) * F.log(1 - inside))), F.sum(d * z), F.sum(d), F.sum(c * z * z), F.sum(c * z), F.sum(c)).first()
        loss = s[0] + l2 * ((a - 1) ** 2 + b**2) / 2
        return loss, np.array([s[1] + l2 * (a - 1), s[2] + l2 * b]), np.array([[s[3] + l2, s[4]], [s[4], s[5] + l2]])

    at = np.array([1.0, 0.0])
    loss, grad, hess = look(*at)
    for _ in range(most_steps):
        move = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-4:
            new = look(*(at - size * move))
            if new[0] <= loss + 1e-12:
                break
            size /= 2
        else:
            break
        at = at - size * move
        loss, grad, hess = new
        if np.linalg.norm(size * move) <= tolerance:
            break
    return Calibration(float(at[0]), float(at[1]), eps)


def fit_trees(train: DataFrame, features: Sequence[str], label: str, *, weight: str | None = None, validation: str | None = None, rounds: int = 50, depth: int = 4, seed: int = 7):
    """Gradient-boosted trees; with ``validation``, a boolean column, boosting stops early on those rows."""
    filled = train.fillna(0.0, list(features)).withColumn("_label", F.col(label).cast("double"))
    table = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(filled)
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=rounds, maxDepth=depth, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(table)


def tree_scores(model, df: DataFrame, features: Sequence[str], out: str = "prob_positive") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    table = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(df.fillna(0.0, list(features)))
    return model.transform(table).withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def is_collapsed(df: DataFrame, score: str, least_distinct: int = 3) -> bool:
    """Whether a scorer gives (almost) the same probability everywhere."""
    return df.select(F.round(score, 6)).distinct().limit(least_distinct).count() < least_distinct


def family_gains(importances: dict[str, float], families: dict[str, Sequence[str]]) -> dict[str, float]:
    """Each family's share of all importance; a feature counts for the first family that names it."""
    left, total, out = dict(importances), sum(importances.values()) or 1.0, {}
    for family, names in families.items():
        out[family] = sum(left.pop(n, 0.0) for n in names) / total
    return out | {"other": sum(left.values()) / total}


def best_model(metrics: DataFrame, order: Sequence[tuple[str, bool]], family: str = "family") -> DataFrame:
    """The best row of each family by (metric, higher is better) in order, ties to the lesser model_id."""
    keys = [F.desc_nulls_last(m) if high else F.asc_nulls_last(m) for m, high in order]
    return metrics.withColumn("_k", F.row_number().over(Window.partitionBy(family).orderBy(*keys, "model_id"))).filter("_k = 1").drop("_k")
