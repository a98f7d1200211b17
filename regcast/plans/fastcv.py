"""Fold-additive cross-validation and grid search for Gram-solved models.

For the linear family solved on moments (OLS, ridge, lasso, elastic net,
LARS, Lasso-LARS, Bayesian ridge, PLS, tweedie with power ≤ 0) a K-fold
evaluation needs no per-fold scans:

* ONE grouped pass computes shifted moments of the *raw* design (global
  one-hot indicators, raw numerics, target) per fold, plus per-fold
  min / max for min-max columns;
* the training moments of fold f are ``total − fold f`` (exact);
* the fold's encoders (standard / min-max scalers, target scaling) are
  affine, so they are applied to the moments algebraically; one-hot levels
  absent from a fold's training rows are all-zero columns and get a zero
  coefficient, exactly like an unknown level in a refitted encoder;
* out-of-fold predictions are ONE projection (``CASE fold``) and grid
  scores are R² from each test fold's moments — no extra scan at all.

Plans with ordinal columns (codes depend on the fold's category set),
feature selection or lookback fall back to per-fold refits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import MIN_MAX, NONE, ONE_HOT, ORDINAL, STANDARD, plan_steps
from ..operators import linear as L
from ..operators.encoders import refuse_wide_one_hot
from ..operators.gram import Moments, gram

G1_KEYS = {
    "linear_regression": lambda m, f, **p: L.ols_from_moments(m, f),
    "ridge": lambda m, f, alpha=1.0, **p: L.ridge_from_moments(m, f, alpha),
    "lasso": lambda m, f, alpha=1.0, **p: L.enet_from_moments(m, f, alpha, 1.0),
    "elastic_net": lambda m, f, alpha=1.0, l1_ratio=0.5, **p: L.enet_from_moments(m, f, alpha, l1_ratio),
    "lars": lambda m, f, n_nonzero_coefs=500, **p: L.lars_from_moments(m, f, n_nonzero_coefs=n_nonzero_coefs),
    "lasso_lars": lambda m, f, alpha=1.0, **p: L.lars_from_moments(m, f, alpha=alpha),
    "bayesian_ridge": lambda m, f, max_iter=300, **p: L.bayesian_ridge_from_moments(m, f, max_iter=max_iter),
    "pls_regression": lambda m, f, n_components=1, **p: L.pls_from_moments(m, f, n_components),
    "tweedie_regressor": lambda m, f, alpha=1.0, **p: L.ridge_from_moments(m, f, m.n * alpha),
}


def eligible(cfg, steps, params: dict | None = None) -> bool:
    if cfg.lookback is not None or cfg.feature_selection is not None:
        return False
    if cfg.model.key not in G1_KEYS:
        return False
    merged = {**cfg.model.params, **(params or {})}
    if cfg.model.key == "tweedie_regressor" and float(merged.get("power", 0.0)) > 0:
        return False
    if cfg.model.key == "pls_regression" and cfg.target_processing != NONE:
        return False
    return all(s[2] in (ONE_HOT, STANDARD, MIN_MAX, NONE) and s[2] != ORDINAL for s in steps)


def affine(m: Moments, a: np.ndarray, d: np.ndarray) -> Moments:
    """Moments of ``(z − a) / d`` from moments of ``z`` (exact algebra)."""
    return Moments(m.n, (m.shift - a) / d, m.s / d, m.S / np.outer(d, d))


class _Design:
    """Raw design columns (global one-hot levels, raw numerics) + metadata."""

    def __init__(self, df: DataFrame, cfg, steps):
        self.steps = [s for s in steps if s[0] in set(cfg.features)]
        onehot = [s[0] for s in self.steps if s[2] == ONE_HOT]
        cats = {}
        refuse_wide_one_hot(df, onehot)
        if onehot:
            row = df.agg(*[F.array_sort(F.collect_set(F.col(c))).alias(f"c{i}") for i, c in enumerate(onehot)]).first()
            cats = {c: list(row[f"c{i}"]) for i, c in enumerate(onehot)}
        self.cols: list[tuple[str, Column, str, str]] = []  # (name, expr, kind, source)
        for v, _t, step, _u in self.steps:
            if step == ONE_HOT:
                for j, lvl in enumerate(cats[v]):
                    self.cols.append((f"_d{len(self.cols)}", (F.col(v) == F.lit(lvl)).cast("double"), "onehot", v))
            else:
                self.cols.append((f"_d{len(self.cols)}", F.col(v).cast("double"), step, v))
        self.names = [c[0] for c in self.cols]

    def frame(self, df: DataFrame, keep) -> DataFrame:
        return df.select(*keep, *[e.alias(n) for n, e, _, _ in self.cols])


def _fold_minmax(data: DataFrame, cols, fold: str) -> dict:
    if not cols:
        return {}
    rows = data.groupBy(fold).agg(*[x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).collect()
    return {r[fold]: {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in cols} for r in rows}


def _scalers(design: _Design, train: Moments, fold_mm: dict, folds_out: list, target_kind: str, y_mm: tuple | None):
    """Affine (a, d) per design column + target for one fold's training rows."""
    q = len(design.names) + 1
    a, d = np.zeros(q), np.ones(q)
    C = train.centered()
    mu = train.means()
    for j, (name, _e, kind, _src) in enumerate(design.cols):
        if kind == STANDARD:
            sd = np.sqrt(max(C[j, j], 0.0) / train.n)
            a[j], d[j] = mu[j], (sd if sd > 0 else 1.0)
        elif kind == MIN_MAX:
            lo = min(fold_mm[f][name][0] for f in folds_out)
            hi = max(fold_mm[f][name][1] for f in folds_out)
            a[j], d[j] = lo, ((hi - lo) if hi != lo else 1.0)
    if target_kind == STANDARD:
        sd = np.sqrt(max(C[-1, -1], 0.0) / train.n)
        a[-1], d[-1] = mu[-1], (sd if sd > 0 else 1.0)
    elif target_kind == MIN_MAX:
        lo, hi = y_mm
        a[-1], d[-1] = lo, ((hi - lo) if hi != lo else 1.0)
    return a, d


def _raw_coefficients(model, a, d):
    """(w_raw, b_raw) with prediction = (b_raw + x·w_raw)·d_y + a_y."""
    w = np.asarray(model.coef) / d[:-1]
    b = float(model.intercept) - float(np.sum(np.asarray(model.coef) * a[:-1] / d[:-1]))
    return w, b


class FoldMoments:
    """Everything one grouped pass yields for K folds."""

    def __init__(self, tagged: DataFrame, cfg, steps, fold: str = "fold"):
        self.cfg = cfg
        self.design = _Design(tagged, cfg, steps)
        self.fold = fold
        t = cfg.target
        self.data = self.design.frame(tagged, [fold, F.col(t).cast("double").alias("_yt")])
        mm_cols = [n for n, _e, kind, _s in self.design.cols if kind == MIN_MAX]
        if cfg.target_processing == MIN_MAX:
            mm_cols = mm_cols + ["_yt"]
        self.fold_mm = _fold_minmax(self.data, mm_cols, fold)
        self.per_fold = gram(self.data, self.design.names, "_yt", group=fold)
        self.total = None
        for m in self.per_fold.values():
            self.total = m if self.total is None else self.total + m
        self.folds = sorted(self.per_fold)

    def fit_fold(self, f, params: dict):
        train = self.total - self.per_fold[f]
        others = [g for g in self.folds if g != f]
        y_mm = None
        if self.cfg.target_processing == MIN_MAX:
            y_mm = (min(self.fold_mm[g]["_yt"][0] for g in others), max(self.fold_mm[g]["_yt"][1] for g in others))
        a, d = _scalers(self.design, train, self.fold_mm, others, self.cfg.target_processing, y_mm)
        merged = {**self.cfg.model.params, **params}
        model = G1_KEYS[self.cfg.model.key](affine(train, a, d), self.design.names, **merged)
        w, b = _raw_coefficients(model, a, d)
        return w, b, a[-1], d[-1]

    def test_r2(self, f, w, b, ay, dy) -> float:
        """R² of fold f's predictions from its own moments (no scan)."""
        m = self.per_fold[f]
        # prediction ŷ = α + x·β with α = b·dy + ay, β = w·dy; from centred moments, which do not cancel
        # when the mean is large: residuals spread around their mean, plus the mean itself
        C, p = m.centered(), len(w)
        alpha, beta = b * dy + ay, w * dy
        mean = m.s / m.n + m.shift
        off = mean[p] - alpha - beta @ mean[:p]
        ss_res = C[p, p] - 2 * (beta @ C[:p, p]) + beta @ C[:p, :p] @ beta + m.n * off * off
        ss_tot = C[p, p]
        if ss_tot == 0:
            return 1.0 if abs(ss_res) < 1e-12 else 0.0
        return float(1.0 - ss_res / ss_tot)

    def predictions(self, tagged: DataFrame, params: dict, keep) -> DataFrame:
        expr = None
        for f in self.folds:
            w, b, ay, dy = self.fit_fold(f, params)
            e = F.lit(b)
            for name, wj in zip(self.design.names, w):
                if wj != 0.0:
                    e = e + F.lit(float(wj)) * F.col(name)
            e = e * F.lit(dy) + F.lit(ay)
            expr = F.when(F.col(self.fold) == f, e) if expr is None else expr.when(F.col(self.fold) == f, e)
        frame = self.design.frame(tagged, [*keep, self.fold, F.col(self.cfg.target).cast("double").alias("Real")])
        return frame.select(*keep, "Real", expr.alias("Prediction"))


def steps_of(df: DataFrame, cfg):
    from ..functions.profile import preprocessing_plan

    plan = cfg.plan if cfg.plan is not None else preprocessing_plan(df, cfg.features)
    return plan_steps(plan) if isinstance(plan, DataFrame) else [tuple(s) for s in plan]
