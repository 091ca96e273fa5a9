"""Linear models from aggregated sums: least squares, an optimality certificate, models as tables.

A model is a table of one row per feature (feature, mean, std, coef) and one for the intercept, so it
is saved, loaded and joined like any data, and scored by column expressions without a UDF.
Fitting reads the rows twice, each time in one partial-aggregated pass: once for the scaler and
once for the Gram matrix; what reaches the driver is (features + 1) squared numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import flag
from .predict import require_rows, scaler_stats

INTERCEPT = "(intercept)"
MODEL = "feature string, mean double, std double, coef double"
#: A pivot of the standardised Gram matrix (the diagonal is 1 per row) at or under this makes its feature redundant.
PIVOT_MIN = 1e-9


def scaled(name: str, mean: float, std: float) -> Column:
    return (F.col(name).cast("double") - F.lit(float(mean))) / F.lit(float(std))


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """Sums of all products of ``columns``, times ``weight`` if given, in one aggregation.

    Rows with a null among them count in no sum. The result is symmetric, zero for no rows.
    """
    k = len(columns)
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], (weight if weight is not None else F.lit(1.0)).alias("w"))
    rows = rows.dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, got):
        out[i, j] = out[j, i] = v or 0.0
    return out


def cholesky_solve(a: np.ndarray, b: np.ndarray, least: float = PIVOT_MIN) -> np.ndarray:
    """Solution of a x = b for a symmetric, positive semidefinite ``a``, features in turn.

    A feature that depends on the ones before it (its pivot is at most ``least``) gets 0.
    """
    k = len(b)
    low, y = np.zeros((k, k)), np.zeros(k)
    used = np.zeros(k, dtype=bool)
    for i in range(k):
        for j in range(i):
            if used[j]:
                low[i, j] = (a[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        pivot = a[i, i] - low[i, :i] @ low[i, :i]
        if pivot > least:
            used[i] = True
            low[i, i] = np.sqrt(pivot)
            y[i] = (b[i] - low[i, :i] @ y[:i]) / low[i, i]
        else:
            low[i] = 0.0
    x = np.zeros(k)
    for i in reversed(range(k)):
        if used[i]:
            x[i] = (y[i] - low[i + 1:, i] @ x[i + 1:]) / low[i, i]
    return x


def _table(spark: SparkSession, stats: dict, features, intercept: float, coef) -> DataFrame:
    rows = [(f, float(stats[f][0]), float(stats[f][1]), float(c)) for f, c in zip(features, coef)]
    return spark.createDataFrame([(INTERCEPT, 0.0, 1.0, float(intercept)), *rows], MODEL)


def fit_least_squares(train: DataFrame, features, label: str = "label") -> DataFrame:
    """Ordinary least squares on standardised features, as a model table.

    The features used are those of ``features`` that the frame has. Rows with a null feature or
    label are left out; a feature that others determine (a constant one too) gets 0. No usable
    row raises RuntimeError.
    """
    feats = [c for c in features if c in train.columns]
    require_rows(train, "training part of the least-squares fit", "check the joins and the filters before it")
    rows = train.select(label, *feats).dropna()
    stats = {r["feature"]: (r["mean"], r["std"]) for r in scaler_stats(rows, feats).collect()}
    if any(m is None for m, _ in stats.values()):
        raise RuntimeError("every training row has a null among its features or label")
    g = gram(rows, [F.lit(1.0), *[scaled(f, *stats[f]) for f in feats], F.col(label).cast("double")])
    n, k = g[0, 0], len(feats)
    # sums round the means: the intercept is then apart from the other coefficients
    mean = g[0] / n
    centred = g / n - np.outer(mean, mean)
    coef = cholesky_solve(centred[1: k + 1, 1: k + 1], centred[1: k + 1, k + 1])
    return _table(train.sparkSession, stats, feats, mean[k + 1] - mean[1: k + 1] @ coef, coef)


def linear_score(model: DataFrame) -> Column:
    """intercept + sum of coef * (x - mean) / std as one column expression (a model is a few rows)."""
    out, rows = F.lit(0.0), {r["feature"]: r for r in model.collect()}
    for f in sorted(rows, key=lambda f: (f != INTERCEPT, f)):
        r = rows[f]
        out = out + (F.lit(r["coef"]) if f == INTERCEPT else F.lit(r["coef"]) * scaled(f, r["mean"], r["std"]))
    return out


def predict_linear(model: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``; null where a feature is."""
    return df.withColumn("prediction", linear_score(model))


def predict_risk(model: DataFrame, df: DataFrame, threshold: float = codes.THRESHOLD) -> DataFrame:
    """``df`` with score (the sigmoid of the linear score), pred and risk; a null feature gives a null score."""
    score = 1.0 / (1.0 + F.exp(-linear_score(model)))
    high = F.col("score") > F.lit(threshold)
    return (df.withColumn("score", score).withColumn("pred", flag(high))
            .withColumn("risk", F.when(high, F.lit("HIGH")).when(F.col("score").isNotNull(), F.lit("LOW"))))


def save_table(model: DataFrame, path: str) -> None:
    """Store a model table as one Parquet file per writing task; an existing model is replaced."""
    model.select("feature", "mean", "std", "coef").coalesce(1).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def from_pipeline(spark: SparkSession, stats_rows, features, intercept: float, coef) -> DataFrame:
    """The model table of an MLlib fit on features that were scaled by ``stats_rows``."""
    return _table(spark, {r["feature"]: (r["mean"], r["std"]) for r in stats_rows}, features, intercept, coef)


def logistic_certificate(model: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """feature, gradient: slope of the balanced, regularised (C = 1) logistic loss per row at ``model``.

    Each class weighs n / (2 * its rows). At the optimum every gradient is 0, which holds whatever
    solver found it. One aggregation over the rows; the regularisation leaves the intercept out.
    """
    rows = {r["feature"]: r for r in model.collect()}
    feats = [f for f in rows if f != INTERCEPT]
    data = train.select(label, *feats).dropna()
    n, ones = data.agg(F.count(F.lit(1)), F.sum(flag(F.col(label) == 1))).first()
    ones = ones or 0
    share = F.when(F.col(label) == 1, F.lit(n / (2.0 * max(ones, 1)))).otherwise(F.lit(n / (2.0 * max(n - ones, 1))))
    miss = share * (1.0 / (1.0 + F.exp(-linear_score(model))) - F.col(label))
    sums = data.agg(*[F.sum(miss * (F.lit(1.0) if f == INTERCEPT else scaled(f, rows[f]["mean"], rows[f]["std"]))).alias(f"g{i}")
                      for i, f in enumerate(rows)]).first()
    out = [(f, ((sums[i] or 0.0) + (0.0 if f == INTERCEPT else rows[f]["coef"])) / max(n, 1)) for i, f in enumerate(rows)]
    return train.sparkSession.createDataFrame(out, "feature string, gradient double")
