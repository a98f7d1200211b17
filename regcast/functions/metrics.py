"""Regression metrics and result frames (A1-A4).

``metrics_frame`` is one aggregate (two passes are avoided by using the
identity SS_tot = sum(y^2) - n*mean^2 on centred moments computed with
``var_pop``), returning R², MAE, RMSE and MAPE in percent.  MAPE is null
when any actual value is zero (the reference code's rule).  A constant
actual column gives R² = 1 if the predictions are perfect, else 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = 2.220446049250313e-16  # float64 machine epsilon (MAPE denominator floor)


@dataclass(frozen=True)
class RegressionMetrics:
    r2: float
    mae: float
    rmse: float
    mape: float | None


def metrics_frame(df: DataFrame, actual: str = "Real", predicted: str = "Prediction") -> DataFrame:
    y = F.col(actual).cast("double")
    p = F.col(predicted).cast("double")
    err = y - p
    ss_res = F.sum(err * err)
    ss_tot = F.var_pop(y) * F.count(F.lit(1))
    r2 = (
        F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - ss_res / ss_tot)
    )
    mape = F.when(
        F.count_if(y == 0) == 0,
        F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(_EPS))) * 100.0,
    )
    return df.agg(
        r2.alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        mape.alias("mape"),
    )


def calculate_metrics(df: DataFrame, actual: str = "Real", predicted: str = "Prediction") -> RegressionMetrics:
    row = metrics_frame(df, actual, predicted).first()
    return RegressionMetrics(row["r2"], row["mae"], row["rmse"], row["mape"])


def prediction_frame(df: DataFrame, prediction: str, target: str | None, keep=()) -> DataFrame:
    """A2: ``Real, Prediction`` (only ``Prediction`` when no target column)."""
    cols = [F.col(k) for k in keep]
    if target is not None and target in df.columns:
        cols += [F.col(target).cast("double").alias("Real")]
    cols.append(F.col(prediction).cast("double").alias("Prediction"))
    return df.select(*cols)


def long_form(indexed_predictions: DataFrame, idx_col: str = "idx") -> DataFrame:
    """A3: ``Row`` (1-based), ``Series``, ``Value`` for plotting."""
    value_cols = [c for c in ("Real", "Prediction") if c in indexed_predictions.columns]
    base = indexed_predictions.select((F.col(idx_col) + 1).alias("Row"), *value_cols)
    return base.unpivot(["Row"], value_cols, "Series", "Value")
