"""Exact kernels: ridge and Gaussian process against the dense solve, support vectors by their duality gap."""

import json
import warnings

import numpy as np
import pandas as pd
import pytest

from regcast.operators import kernel_exact as KE
from regcast.operators import kernels as K
from regcast.operators.models import model_from_dict


def frame(spark, X, y, parts=5):
    return spark.createDataFrame(pd.DataFrame({**{f"f{j}": X[:, j] for j in range(X.shape[1])}, "y": y, "idx": np.arange(len(y))})).repartition(parts)


def data(n, p, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    return X, np.sin(X[:, 0]) + X[:, -1] * X[:, 0] + 0.3 * rng.normal(size=n), rng.normal(size=(100, p))


def names(X):
    return [f"f{j}" for j in range(X.shape[1])]


@pytest.mark.parametrize("n,p,rank", [(3000, 6, 4096), (1000, 10, 100)])
def test_gaussian_process_equals_the_dense_solve(spark, monkeypatch, n, p, rank):
    """By pivots that span the kernel, and by conjugate gradients where they do not reach."""
    X, y, T = data(n, p)
    monkeypatch.setattr(KE, "MAX_RANK", rank)
    m = K.gaussian_process_fit(frame(spark, X, y), names(X), "y", alpha=1e-3)
    dense = K.kernel_matrix(T, X, "rbf", 0.5) @ np.linalg.solve(K.kernel_matrix(X, X, "rbf", 0.5) + 1e-3 * np.eye(len(y)), y)
    assert np.abs(m.predict_numpy(T) - dense).max() < 1e-6
    assert ("steps" in m.extra) == (rank == 100)


def test_the_default_process_interpolates(spark):
    X, y, _ = data(800, 4, seed=2)
    m = K.gaussian_process_fit(frame(spark, X, y), names(X), "y")
    Km = K.kernel_matrix(X, X, "rbf", 0.5)
    assert np.abs(m.predict_numpy(X) - Km @ np.linalg.solve(Km + 1e-10 * np.eye(len(y)), y)).max() < 1e-5
    assert np.abs(m.predict_numpy(X) - y).max() < 1e-2


def test_smooth_kernels_need_few_pivots_and_repeated_rows_are_fine(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.uniform(-1, 1, 400), 5)[:, None]
    y = np.cos(3 * x[:, 0]) + rng.normal(scale=0.1, size=2000)
    m = K.gaussian_process_fit(frame(spark, x, y), ["f0"], "y", alpha=0.01)
    Km = K.kernel_matrix(x, x, "rbf", 0.5)
    assert m.extra["rank"] < 20
    assert np.abs(m.predict_numpy(x) - Km @ np.linalg.solve(Km + 0.01 * np.eye(2000), y)).max() < 1e-6


@pytest.mark.parametrize("kernel,kw", [("rbf", {"gamma": 0.1}), ("poly", {"degree": 2, "gamma": 0.5, "coef0": 1.0}), ("poly", {"degree": 3})])
def test_kernel_ridge_equals_the_dense_solve(spark, kernel, kw):
    X, y, T = data(500, 3, seed=1)
    m = K.kernel_ridge_fit(frame(spark, X, y), names(X), "y", alpha=0.5, kernel=kernel, **kw)
    args = (kernel, kw.get("gamma", 1 / 3), kw.get("degree", 3), kw.get("coef0", 1.0))
    dense = K.kernel_matrix(T, X, *args) @ np.linalg.solve(K.kernel_matrix(X, X, *args) + 0.5 * np.eye(len(y)), y)
    assert np.abs(m.predict_numpy(T) - dense).max() < 1e-6


def svr_objectives(m, X, y, C, epsilon, kernel):
    """Primal and dual objective from the model's coefficients alone."""
    f = m.predict_numpy(X)
    norm = m.a @ K.kernel_matrix(m.X, m.X, *kernel) @ m.a
    index = [int(np.flatnonzero((X == row).all(axis=1))[0]) for row in m.X]
    primal = 0.5 * norm + C * np.maximum(np.abs(y - f) - epsilon, 0).sum()
    return primal, -0.5 * norm + m.a @ y[index] - epsilon * np.abs(m.a).sum()


@pytest.mark.parametrize("kernel", [("rbf", 0.3), ("linear", 1.0), ("poly", 0.2, 2, 1.0)])
def test_svr_closes_the_duality_gap(spark, kernel):
    X, y, _ = data(400, 3, seed=5)
    kw = dict(zip(("kernel", "gamma", "degree", "coef0"), kernel, strict=False))
    m = K.svr_fit(frame(spark, X, y), names(X), "y", C=2.0, epsilon=0.1, **kw)
    primal, dual = svr_objectives(m, X, y, 2.0, 0.1, kernel)
    assert abs(m.a.sum()) < 1e-9 and np.abs(m.a).max() <= 2.0
    assert 0 <= primal - dual < 1e-3 * primal and abs(m.extra["gap"]) < 1e-3


def test_svr_with_more_rows_than_a_working_set(spark, monkeypatch):
    monkeypatch.setattr(KE, "WORKING_SET", 32)
    X, y, _ = data(300, 2, seed=6)
    m = K.svr_fit(frame(spark, X, y), names(X), "y", gamma=0.5)
    monkeypatch.setattr(KE, "WORKING_SET", 1200)
    whole = K.svr_fit(frame(spark, X, y, 2), names(X), "y", gamma=0.5)
    assert m.extra["steps"] > whole.extra["steps"] and np.abs(m.predict_numpy(X) - whole.predict_numpy(X)).max() < 5e-3


def test_nu_bounds_the_share_outside_the_tube(spark):
    rng = np.random.default_rng(21)
    x = rng.uniform(-2, 2, 400)[:, None]
    y = np.sin(x[:, 0]) + rng.normal(scale=0.2, size=400)
    for nu in (0.2, 0.6):
        m = K.nu_svr_fit(frame(spark, x, y), ["f0"], "y", nu=nu, C=10.0, gamma=1.0)
        r = np.abs(y - m.predict_numpy(x))
        assert (r > m.extra["epsilon"] + 2e-3).mean() <= nu + 1e-9 and (r >= m.extra["epsilon"] - 2e-3).mean() >= nu - 1e-9
        assert abs(m.extra["gap"]) < 1e-3
        again = K.svr_fit(frame(spark, x, y), ["f0"], "y", epsilon=m.extra["epsilon"], C=10.0, gamma=1.0)
        assert np.abs(again.predict_numpy(x) - m.predict_numpy(x)).max() < 0.02


@pytest.mark.parametrize("fit", [K.gaussian_process_fit, K.svr_fit, K.nu_svr_fit])
def test_models_survive_json_and_score_in_spark(spark, fit):
    X, y, _ = data(60, 2, seed=8)
    df = frame(spark, X, y)
    m = fit(df, names(X), "y")
    again = model_from_dict(json.loads(json.dumps(m.to_dict())))
    got = again.transform(df, "p").orderBy("idx").toPandas()["p"].to_numpy()
    assert np.allclose(got, m.predict_numpy(X), atol=1e-9)


def test_too_many_rows_for_an_exact_kernel_are_refused(spark, monkeypatch):
    monkeypatch.setattr(KE, "MAX_CELLS", 100)
    X, y, _ = data(50, 2)
    with pytest.raises(ValueError, match="n_landmarks"):
        K.svr_fit(frame(spark, X, y), names(X), "y")


def test_constant_targets_and_features(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        df = frame(spark, np.ones((20, 2)), np.full(20, 3.0))
        assert np.allclose(K.svr_fit(df, ["f0", "f1"], "y").predict_numpy(np.ones((2, 2))), 3.0, atol=0.11)
        assert np.allclose(K.gaussian_process_fit(df, ["f0", "f1"], "y").predict_numpy(np.ones((2, 2))), 3.0)
        assert np.allclose(K.kernel_ridge_fit(frame(spark, np.zeros((5, 1)), np.ones(5)), ["f0"], "y", kernel="poly", coef0=0.0).predict_numpy(np.zeros((1, 1))), 0.0)
