"""Feature scores and k-best selection (FS0-FS5).

* F-regression: one aggregate of ``corr(x_j, y)`` for all features.
* RReliefF / ReliefF and mRMR (KSG mutual information) need nearest
  neighbours; they run on the anchor engine in :mod:`.neighbors` — anchors
  are broadcast in size-checked chunks, every partition keeps only its
  best k candidates per anchor, and a ``row_number`` merge keeps the
  global k.  Ties between equal distances go to the lower row index.
Only feature-sized score vectors reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FMAX = float(np.finfo(float).max)


def f_regression_scores(df: DataFrame, features, target: str) -> np.ndarray:
    feats = list(features)
    y = F.col(target).cast("double")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.corr(F.col(f).cast("double"), y).alias(f"c{i}") for i, f in enumerate(feats)]).first()
    n = int(row["n"])
    out = np.zeros(len(feats))
    for i in range(len(feats)):
        c = row[f"c{i}"]
        if c is None or c != c:
            out[i] = 0.0
        elif abs(c) >= 1.0:
            out[i] = _FMAX
        else:
            out[i] = c * c / (1.0 - c * c) * (n - 2)
    return out


def score_table(spark, features, scores) -> DataFrame:
    rows = [(f, i, float(s)) for i, (f, s) in enumerate(zip(features, scores))]
    schema = T.StructType(
        [T.StructField("Variable", T.StringType()), T.StructField("position", T.LongType()), T.StructField("score", T.DoubleType())]
    )
    return spark.createDataFrame(rows, schema)


def f_regression_table(df: DataFrame, features, target: str) -> DataFrame:
    return score_table(df.sparkSession, list(features), f_regression_scores(df, features, target))


def k_best_indices(scores, k: int) -> list[int]:
    """Indices of the k best scores; NaN is lowest, ties go to the later column."""
    s = np.asarray(scores, dtype=float)
    s = np.where(np.isnan(s), -np.inf, s)
    order = sorted(range(len(s)), key=lambda i: (s[i], i))  # stable ascending
    return sorted(order[-k:]) if k > 0 else []


def k_best_flags(table: DataFrame, k: int) -> DataFrame:
    rows = table.orderBy("position").collect()  # one row per feature
    chosen = set(k_best_indices([r["score"] for r in rows], k))
    return table.withColumn("selected", F.col("position").isin(sorted(chosen)))


SCORE_METHODS = ("F Regression", "MRMR Regression", "Relief Regression")


def scores_for(df: DataFrame, features, target: str, method: str) -> np.ndarray:
    if method == "F Regression":
        return f_regression_scores(df, features, target)
    if method == "MRMR Regression":
        from .neighbors import mrmr_scores

        return mrmr_scores(df, features, target)
    if method == "Relief Regression":
        from .neighbors import relief_scores

        return relief_scores(df, features, target)
    raise ValueError(f"Unknown feature selection method: {method}")


def select_k_best(df: DataFrame, features, target: str, method: str, k: int) -> list[str]:
    """FS0: names of the k best features, in their original order."""
    if method not in SCORE_METHODS:
        raise ValueError(f"Unknown feature selection method: {method}")
    if k < 1:
        raise ValueError("The number of selected features must be at least one.")
    features = list(features)
    if k >= len(features):
        return features
    scores = scores_for(df, features, target, method)
    return [features[i] for i in k_best_indices(scores, k)]
