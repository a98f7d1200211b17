"""Driver-side optimisers over distributed loss/gradient aggregates.

The parameter vector is feature-sized and lives on the driver; every
evaluation is ONE Spark aggregate over the (cached) training rows whose
expressions embed the current parameters as literals, so the row-sized
work stays on the executors inside whole-stage codegen.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame


def lbfgs(
    fun: Callable[[np.ndarray], tuple[float, np.ndarray]],
    x0: np.ndarray,
    max_iter: int = 100,
    tol: float = 1e-6,
    memory: int = 10,
) -> np.ndarray:
    """Plain L-BFGS with a backtracking Armijo line search (no SciPy here)."""
    x = np.asarray(x0, dtype=float).copy()
    f, g = fun(x)
    s_hist: list[np.ndarray] = []
    y_hist: list[np.ndarray] = []
    for _ in range(max_iter):
        if np.max(np.abs(g)) <= tol * max(1.0, abs(f)):
            break
        q = g.copy()
        alphas = []
        for s, y in reversed(list(zip(s_hist, y_hist))):
            rho = 1.0 / float(y @ s)
            a = rho * float(s @ q)
            alphas.append((rho, a))
            q -= a * y
        if y_hist:
            q *= float(s_hist[-1] @ y_hist[-1]) / float(y_hist[-1] @ y_hist[-1])
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), (rho, a) in zip(zip(s_hist, y_hist), reversed(alphas)):
            b = rho * float(y @ q)
            q += (a - b) * s
        d = -q
        slope = float(g @ d)
        if slope >= 0:
            d, slope = -g, -float(g @ g)
            s_hist.clear()
            y_hist.clear()
        step = 1.0
        while True:
            x_new = x + step * d
            f_new, g_new = fun(x_new)
            if np.isfinite(f_new) and f_new <= f + 1e-4 * step * slope:
                break
            step *= 0.5
            if step < 1e-12:
                return x
        s, y = x_new - x, g_new - g
        if float(s @ y) > 1e-12:
            s_hist.append(s)
            y_hist.append(y)
            if len(s_hist) > memory:
                s_hist.pop(0)
                y_hist.pop(0)
        converged = abs(f - f_new) <= tol * max(1.0, abs(f))
        x, f, g = x_new, f_new, g_new
        if converged:
            break
    else:
        warnings.warn(f"L-BFGS stopped after {max_iter} iterations before it converged.", stacklevel=2)
    return x


def aggregate_objective(
    df: DataFrame,
    build: Callable[[np.ndarray], tuple[Column, list[Column]]],
) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Wrap ``build(theta) -> (loss_sum_expr, [grad_sum_exprs])`` as ``fun``.

    Each call runs one aggregate job; the result is 1 + len(theta) numbers.
    """

    def fun(theta: np.ndarray):
        loss, grads = build(theta)
        row = df.agg(loss.alias("f"), *[g.alias(f"g{i}") for i, g in enumerate(grads)]).first()
        return float(row["f"]), np.array([row[f"g{i}"] for i in range(len(grads))], dtype=float)

    return fun
