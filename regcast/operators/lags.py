"""Lag features over one long ordered series without a global window.

A plain ``lag() OVER (ORDER BY idx)`` puts the whole table in one task.
Instead rows are cut into blocks of ``B`` consecutive indices; the last
``L`` rows of each block are also copied (a "halo") into the next block, so
``lag(k ≤ L)`` over ``PARTITION BY block ORDER BY idx`` is exact for every
home row.  Each window partition holds at most ``B + L`` rows whatever the
data size or skew, and blocks spread over all executors.  With a
``series`` column the blocks are per series (many series in one job).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 65536


def with_lags(
    df: DataFrame,
    value,
    lags,
    idx: str = "idx",
    names=None,
    block: int = DEFAULT_BLOCK,
    series: str | None = None,
) -> DataFrame:
    """Add ``lag(value, k)`` columns for every k in ``lags`` (null before the start)."""
    lags = [int(k) for k in lags]
    if not lags:
        return df
    if min(lags) < 1:
        raise ValueError("Lags must be positive.")
    L = max(lags)
    B = max(block, 2 * L)
    value_col = F.col(value) if isinstance(value, str) else value
    names = list(names) if names is not None else [f"lag_{k}" for k in lags]
    base = df.withColumn("__lagv", value_col).withColumn("__lagb", F.floor(F.col(idx) / B).cast("long"))
    halo = (F.col(idx) - F.col("__lagb") * B) >= (B - L)
    shifted = base.withColumn(
        "__lags", F.explode(F.when(halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("__lagwb", F.col("__lagb") + F.col("__lags"))
    keys = ([F.col(series)] if series else []) + [F.col("__lagwb")]
    w = Window.partitionBy(*keys).orderBy(F.col(idx))
    out = shifted.select("*", *[F.lag("__lagv", k).over(w).alias(nm) for k, nm in zip(lags, names)])
    return out.where(F.col("__lags") == 0).drop("__lagv", "__lagb", "__lags", "__lagwb")


def lookback_features(df: DataFrame, target, lookback: int, idx: str = "idx", prefix: str | None = None, **kw) -> DataFrame:
    """``<target>_lag_1 … _lag_L``; the first L rows are dropped."""
    if lookback < 1:
        raise ValueError("Lookback must be at least one.")
    name = prefix or (target if isinstance(target, str) else "target")
    names = [f"{name}_lag_{k}" for k in range(1, lookback + 1)]
    out = with_lags(df, target, range(1, lookback + 1), idx=idx, names=names, **kw)
    return out.where(F.col(idx) >= lookback)


def lag_names(target: str, lookback: int) -> list[str]:
    return [f"{target}_lag_{k}" for k in range(1, lookback + 1)]


def windows(df: DataFrame, value: str, lag_indices, idx: str = "idx", series: str | None = None, **kw) -> DataFrame:
    """One training window per row for arbitrary sparse lags.

    ``window`` is ``array(lag_max, …, lag_min)`` (oldest first) and ``label``
    the current value; the first usable row is ``max(lag_indices)``.
    """
    lag_indices = sorted(set(int(k) for k in lag_indices))
    names = [f"lag_{k}" for k in lag_indices]
    out = with_lags(df, value, lag_indices, idx=idx, names=names, series=series, **kw)
    oldest_first = [F.col(n) for n in reversed(names)]
    if series is not None:  # per-series starts are filtered by the caller's own index
        out = out.where(F.col(names[-1]).isNotNull())
    else:
        out = out.where(F.col(idx) >= max(lag_indices))
    return out.select(
        *([F.col(series)] if series else []), F.col(idx), *[F.col(n) for n in names],
        F.array(*oldest_first).alias("window"), F.col(value).cast("double").alias("label")
    )
