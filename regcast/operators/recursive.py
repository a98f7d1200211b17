"""Recursive (lookback) prediction (T2, T3) and the linear-recurrence forecast.

With target lookback every prediction feeds the next row's lags, so the
chain is sequential by definition.  Rows are processed in fixed-size
blocks of consecutive indices: each block is one bounded task
(``applyInPandas`` on a block key) that starts from the previous block's
last L predictions; the driver carries only those L numbers between
blocks and every block's output is checkpointed.  No task ever holds more
than ``block`` rows and nothing row-sized crosses the driver.

Known-history scoring (T3) has no recursion: lags come from the actual
targets (after the stored history) and the model is a projection.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .lags import lag_names, with_lags
from .rowindex import Indexed

BLOCK_ROWS = 1_000_000
SCAN_BLOCK = 65_536  # rows per block of the parallel linear-recurrence scan


def _numpy_scorer(model):
    if not hasattr(model, "predict_numpy"):
        raise ValueError("This model cannot be used with target lookback.")
    return model.predict_numpy


def _linear_parts(fitted):
    """(feature weights, lag weights, intercept) of an identity-link linear model."""
    from .linear import LinearModel

    m = fitted.model
    if not isinstance(m, LinearModel) or m.link != "identity":
        return None
    p = len(fitted.selected)
    return np.asarray(m.coef[:p], dtype=float), np.asarray(m.coef[p:], dtype=float), float(m.intercept)


def _scan_frame(fitted, df: DataFrame, keep, idx: str, parts) -> DataFrame:
    """Parallel exact recursion for a linear model.

    y_t = c_t + Σ_k w_k y_{t−k} with c_t = b + x_t·β is affine in the state
    entering a block, so pass 1 computes every block's state map (L×L + L
    numbers) in parallel, the driver chains the maps (blocks × L² work) and
    pass 2 replays each block from its true incoming state, again in
    parallel.  Exact, and no task holds more than SCAN_BLOCK rows."""
    beta, w, b = parts
    L = len(w)
    feats = list(fitted.selected)
    lags = lag_names(fitted.target, L)
    keep = list(keep)
    enc = fitted.encode(df, keep=keep).withColumn("_blk", F.floor(F.col(idx) / SCAN_BLOCK).cast("long"))
    enc = enc.withColumn("_c", F.lit(b) + sum((F.lit(float(v)) * F.col(f) for f, v in zip(feats, beta)), F.lit(0.0)))

    def run_block(c: np.ndarray, init: np.ndarray):
        """Outputs and lag rows for one block from state ``init`` (newest first)."""
        state = list(init)
        out = np.zeros(len(c))
        lag_rows = np.zeros((len(c), L))
        for t in range(len(c)):
            lag_rows[t] = state
            out[t] = c[t] + float(np.dot(w, state))
            state = [out[t]] + state[:-1]
        return out, lag_rows, np.asarray(state)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        c = pdf["_c"].to_numpy(dtype=float)
        _, _, a = run_block(c, np.zeros(L))
        cols = []
        for j in range(L):
            e = np.zeros(L)
            e[j] = 1.0
            _, _, col = run_block(np.zeros(len(c)), e)
            cols.append(col)
        A = np.column_stack(cols)
        return pd.DataFrame({"_blk": [int(pdf["_blk"].iloc[0])], "A": [A.ravel().tolist()], "a": [a.tolist()]})

    rows = enc.select("_blk", idx, "_c").groupBy("_blk").applyInPandas(maps, "_blk long, A array<double>, a array<double>").collect()
    state = np.asarray(list(reversed(fitted.history))[:L], dtype=float)  # newest first
    starts = {}
    for r in sorted(rows, key=lambda r: r["_blk"]):
        starts[int(r["_blk"])] = state.tolist()
        state = np.asarray(r["A"]).reshape(L, L) @ state + np.asarray(r["a"])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx).reset_index(drop=True)
        init = np.asarray(starts[int(pdf["_blk"].iloc[0])])
        out, lag_rows, _ = run_block(pdf["_c"].to_numpy(dtype=float), init)
        res = pdf[keep + feats].copy()
        for k, name in enumerate(lags):
            res[name] = lag_rows[:, k]
        res["_ps"] = out
        return res

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in enc.schema.fields if f.name in keep]
        + [f"`{c}` double" for c in feats + lags]
        + ["_ps double"]
    )
    return enc.groupBy("_blk").applyInPandas(replay, schema)


def _recursive_frame(fitted, df: DataFrame, keep, idx: str = "idx") -> DataFrame:
    """Scaled predictions and the lag values used, in blocks."""
    parts = _linear_parts(fitted)
    if parts is not None:
        return _scan_frame(fitted, df, keep, idx, parts)
    L = fitted.config.lookback
    feats = list(fitted.selected)
    lags = lag_names(fitted.target, L)
    enc = fitted.encode(df, keep=list(keep))
    score = _numpy_scorer(fitted.model)
    n = enc.count()
    state = list(fitted.history)  # oldest first, scaled
    keep = list(keep)
    schema_fields = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in enc.schema.fields if f.name in keep]
        + [f"`{c}` double" for c in feats + lags]
        + ["_ps double"]
    )
    outputs = []

    def make_run(init):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(idx).reset_index(drop=True)
            X = pdf[feats].to_numpy(dtype=float) if feats else np.zeros((len(pdf), 0))
            hist = list(init)
            lag_vals = np.zeros((len(pdf), L))
            preds = np.zeros(len(pdf))
            for t in range(len(pdf)):
                lag_vals[t] = hist[::-1][:L]
                preds[t] = float(score(np.concatenate([X[t], lag_vals[t]])[None, :])[0])
                hist.append(preds[t])
                hist = hist[-L:]
            out = pdf[keep + feats].copy()
            for k, c in enumerate(lags):
                out[c] = lag_vals[:, k]
            out["_ps"] = preds
            return out

        return run

    for start in range(0, n, BLOCK_ROWS):
        run = make_run(list(state[-L:]))
        block = enc.where((F.col(idx) >= start) & (F.col(idx) < start + BLOCK_ROWS))
        res = block.groupBy(F.lit(start).alias("_blk")).applyInPandas(run, schema_fields)
        if n > BLOCK_ROWS:
            res = materialize(res)
            tail = res.where(F.col(idx) >= min(start + BLOCK_ROWS, n) - L).select(idx, "_ps").collect()
            state = state + [r["_ps"] for r in sorted(tail, key=lambda r: r[0])]
        outputs.append(res)
    out = outputs[0]
    for o in outputs[1:]:
        out = out.unionByName(o)
    return out


def recursive_predict(fitted, df: DataFrame, keep=(), idx: str = "idx") -> DataFrame:
    """Predictions in order, recursively from the stored history
    (state is reset on every call: always starts at the training history)."""
    keep = list(keep) or [idx]
    frame = _recursive_frame(fitted, df, keep, idx)
    return frame.select(*keep, fitted.scaler.invert(F.col("_ps")).alias("Prediction"))


def recursive_lag_frame(fitted, ix: Indexed) -> DataFrame:
    """The processed model input with recursive lag columns."""
    frame = _recursive_frame(fitted, ix.df, [ix.idx], ix.idx)
    return frame.select(ix.idx, *fitted.model_columns())


def known_history_predict(fitted, train_ix: Indexed, test: DataFrame, keep=(), idx: str = "idx") -> DataFrame:
    """One-step predictions whose lags are the stored history followed by
    the ACTUAL (scaled) targets of the rows being scored — fully parallel."""
    L = fitted.config.lookback
    target = fitted.target
    keep = list(keep) or [idx]
    enc = fitted.encode(test, keep=list(dict.fromkeys(keep + [idx, target])))
    y = fitted.scaler.apply(F.col(target))
    hist = fitted.history
    spark = test.sparkSession
    hist_df = spark.createDataFrame([(float(-L + i), float(v)) for i, v in enumerate(hist)], "_i double, _y double")
    series = enc.select(F.col(idx).cast("double").alias("_i"), y.alias("_y")).unionByName(hist_df)
    series = series.withColumn("_j", (F.col("_i") + L).cast("long"))
    lagged = with_lags(series, "_y", range(1, L + 1), idx="_j", names=lag_names(target, L))
    lagged = lagged.where(F.col("_j") >= L).select((F.col("_j") - L).alias(idx), *lag_names(target, L))
    joined = enc.join(lagged, idx)
    scored = fitted.model.transform(joined, "_p")
    return scored.select(*keep, fitted.scaler.invert(F.col("_p")).alias("Prediction"))


def ar_forecast(intercept: float, coefs, history, horizon: int) -> list[float]:
    """Recursive forecast of a linear AR model from ``history`` (oldest first):
    the state is L numbers and the output ``horizon`` numbers."""
    if horizon < 1:
        raise ValueError("Forecast horizon must be at least one.")
    L = len(coefs)
    state = list(history)[-L:]
    out = []
    for _ in range(horizon):
        v = intercept + sum(c * state[-1 - k] for k, c in enumerate(coefs))
        out.append(v)
        state.append(v)
    return out


def ar2_forecast_by_series(df: DataFrame, series: str, order_by, value: str, horizon: int) -> DataFrame:
    """AR(2) least-squares fit and recursive forecast for EVERY series at once.

    One global row index over (series, order) keeps each series contiguous;
    halo lags are taken per (series, block); each series' 3×3 moments are a
    ``groupBy`` aggregate (map-side combined, so a hot series is just a
    larger partial sum), the 2-lag normal equations are solved as column
    expressions, and the horizon recursion is an ``aggregate`` over
    ``sequence(1, horizon)`` — no per-series task, nothing per series on
    the driver.  Output: (series, step, forecast)."""
    from .rowindex import with_row_index

    if horizon < 1:
        raise ValueError("Forecast horizon must be at least one.")
    ix = with_row_index(df.select(series, *order_by, F.col(value).cast("double").alias("_y")), [series, *order_by])
    lagged = with_lags(ix.df, "_y", [1, 2], idx=ix.idx, names=["_l1", "_l2"], series=series)
    y, x1, x2 = F.col("_y"), F.col("_l1"), F.col("_l2")
    fit = lagged.where(x2.isNotNull()).groupBy(series).agg(
        F.covar_pop(x1, x1).alias("s11"), F.covar_pop(x2, x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det)
    b2 = F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det)
    coef = fit.select(series, b1.alias("b1"), b2.alias("b2"), "m1", "m2", "my").withColumn(
        "b0", F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")
    )
    last = lagged.groupBy(series).agg(F.max_by(F.struct(y.alias("y1"), x1.alias("y2")), F.col(ix.idx)).alias("h"))
    both = coef.join(last, series).where(F.col("b1").isNotNull())
    init = F.struct(F.col("h.y1").alias("p1"), F.col("h.y2").alias("p2"), F.array().cast("array<double>").alias("out"))

    def step(acc, _i):
        nxt = F.col("b0") + F.col("b1") * acc["p1"] + F.col("b2") * acc["p2"]
        return F.struct(nxt.alias("p1"), acc["p1"].alias("p2"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    fc = both.select(series, F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)["out"].alias("fc"))
    return fc.select(series, F.posexplode("fc").alias("step", "forecast")).select(
        series, (F.col("step") + 1).cast("long").alias("step"), "forecast"
    )
