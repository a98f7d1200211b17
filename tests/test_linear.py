"""Linear family against NumPy references on a synthetic frame."""

import numpy as np
import pandas as pd
import pytest

from regcast.operators import linear as L
from regcast.operators.gram import gram, total


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 4)) * [1.0, 3.0, 0.5, 2.0] + [10, -5, 0, 100]
    y = 2 * X[:, 0] - 0.5 * X[:, 1] + 0.1 * X[:, 3] + rng.normal(scale=0.3, size=300)
    pdf = pd.DataFrame(X, columns=["a", "b", "c", "d"]).assign(y=y, f=np.arange(300) % 3)
    return spark.createDataFrame(pdf).repartition(4), X, y


FEATS = ["a", "b", "c", "d"]


def _center(X, y):
    return X - X.mean(0), y - y.mean()


def test_gram_moments_and_fold_additivity(data):
    df, X, y = data
    per_fold = gram(df, FEATS, "y", group="f")
    tot = total(per_fold)
    G, c, yty, xm, ym = tot.parts()
    Xc, yc = _center(X, y)
    assert np.allclose(G, Xc.T @ Xc) and np.allclose(c, Xc.T @ yc)
    f = np.arange(300) % 3
    tr = tot - per_fold[0]
    G0, c0, _, _, _ = tr.parts()
    Xt, yt = _center(X[f != 0], y[f != 0])
    assert np.allclose(G0, Xt.T @ Xt) and np.allclose(c0, Xt.T @ yt)


def test_arrow_gram_path_matches_sql_path(data, monkeypatch):
    df, X, y = data
    a = total(gram(df, FEATS, "y")).parts()[0]
    from regcast.operators import gram as G

    monkeypatch.setattr(G, "SQL_MAX_TERMS", 0)
    b = total(G.gram(df, FEATS, "y")).parts()[0]
    assert np.allclose(a, b)


def test_ols_and_ridge(data):
    df, X, y = data
    m = L.moments_of(df, FEATS, "y")
    ols = L.ols_from_moments(m, FEATS)
    A = np.column_stack([X, np.ones(len(y))])
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(ols.coef, ref[:4]) and ols.intercept == pytest.approx(ref[4])
    rid = L.ridge_from_moments(m, FEATS, alpha=10.0)
    Xc, yc = _center(X, y)
    w = np.linalg.solve(Xc.T @ Xc + 10 * np.eye(4), Xc.T @ yc)
    assert np.allclose(rid.coef, w)


def _cd_enet(X, y, alpha, rho, iters=5000):
    Xc, yc = _center(X, y)
    n, p = Xc.shape
    w = np.zeros(p)
    for _ in range(iters):
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            z = Xc[:, j] @ r
            w[j] = np.sign(z) * max(abs(z) - n * alpha * rho, 0) / (Xc[:, j] @ Xc[:, j] + n * alpha * (1 - rho))
    return w


def test_lasso_enet_and_lasso_lars_agree_with_cd(data):
    df, X, y = data
    m = L.moments_of(df, FEATS, "y")
    for alpha, rho in [(0.1, 1.0), (0.2, 0.5)]:
        got = L.enet_from_moments(m, FEATS, alpha, rho).coef
        assert np.allclose(got, _cd_enet(X, y, alpha, rho), atol=1e-6)
    ll = L.lars_from_moments(m, FEATS, alpha=0.1).coef
    assert np.allclose(ll, _cd_enet(X, y, 0.1, 1.0), atol=1e-6)


def test_lars_full_path_is_ols(data):
    df, X, y = data
    m = L.moments_of(df, FEATS, "y")
    assert np.allclose(L.lars_from_moments(m, FEATS, 500).coef, L.ols_from_moments(m, FEATS).coef)
    one = L.lars_from_moments(m, FEATS, 1).coef
    assert np.count_nonzero(one) == 1


def test_bayesian_ridge_matches_numpy_svd_iteration(data):
    df, X, y = data
    got = L.bayesian_ridge_from_moments(L.moments_of(df, FEATS, "y"), FEATS)
    Xc, yc = _center(X, y)
    n, p = Xc.shape
    U, S, Vh = np.linalg.svd(Xc, full_matrices=False)
    ev = S ** 2
    a, lam = 1.0 / (np.var(yc) + np.finfo(float).eps), 1.0
    old = None
    for it in range(300):
        coef = Vh.T @ (Vh / (ev + lam / a)[:, None]) @ (Xc.T @ yc)
        rmse = np.sum((yc - Xc @ coef) ** 2)
        gamma = np.sum(a * ev / (lam + a * ev))
        lam = (gamma + 2e-6) / (np.sum(coef ** 2) + 2e-6)
        a = (n - gamma + 2e-6) / (rmse + 2e-6)
        if old is not None and np.sum(np.abs(old - coef)) < 1e-3:
            break
        old = coef
    coef = Vh.T @ (Vh / (ev + lam / a)[:, None]) @ (Xc.T @ yc)
    assert np.allclose(got.coef, coef, rtol=1e-6)


def test_pls_matches_numpy_nipals(data):
    df, X, y = data
    got = L.pls_from_moments(L.moments_of(df, FEATS, "y"), FEATS, n_components=2)
    xs = X.std(0, ddof=1)
    Xs = (X - X.mean(0)) / xs
    ys = y.std(ddof=1)
    Y = (y - y.mean()) / ys
    W, P, Q = [], [], []
    Xk, Yk = Xs.copy(), Y.copy()
    for _ in range(2):
        w = Xk.T @ Yk
        w /= np.linalg.norm(w)
        t = Xk @ w
        p_ = Xk.T @ t / (t @ t)
        q = Yk @ t / (t @ t)
        Xk = Xk - np.outer(t, p_)
        Yk = Yk - t * q
        W.append(w), P.append(p_), Q.append(q)
    W, P, Q = np.array(W).T, np.array(P).T, np.array(Q)
    coef = (W @ np.linalg.pinv(P.T @ W) @ Q) * ys / xs
    assert np.allclose(got.coef, coef)


def test_huber_stationarity(data):
    df, X, y = data
    m = L.huber_fit(df, ["a", "b"], "y", epsilon=1.35, alpha=1e-4)
    w, b, s = m.coef, m.intercept, m.extra["scale"]
    r = y - X[:, :2] @ w - b
    inl = np.abs(r) <= 1.35 * s
    psi = np.where(inl, -2 * r / s, -2 * 1.35 * np.sign(r))
    g = X[:, :2].T @ psi + 2e-4 * w
    assert np.max(np.abs(g)) < 1e-2 * len(y)


def test_quantile_median_regression_balances_residuals(data):
    df, X, y = data
    m = L.quantile_fit(df, ["a"], "y", quantile=0.5, alpha=0.0)
    r = y - X[:, 0] * m.coef[0] - m.intercept
    assert abs(np.sum(r > 0) - np.sum(r < 0)) <= 4


def test_tweedie_power_zero_is_scaled_ridge(data):
    df, X, y = data
    m = L.tweedie_fit(df, FEATS, "y", power=0.0, alpha=0.5)
    Xc, yc = _center(X, y)
    w = np.linalg.solve(Xc.T @ Xc + len(y) * 0.5 * np.eye(4), Xc.T @ yc)
    assert np.allclose(m.coef, w)


def test_tweedie_log_link_gradient_is_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = np.exp(0.3 * x + 1.0) * rng.gamma(5.0, 0.2, size=200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    m = L.tweedie_fit(df, ["x"], "y", power=2.0, alpha=0.01)
    mu = np.exp(m.coef[0] * x + m.intercept)
    g = np.mean((mu - y) * mu ** (1 - 2.0) * x) + 0.01 * m.coef[0]
    assert abs(g) < 1e-5


def test_sgd_objective_l2_matches_closed_form(data):
    df, X, y = data
    m = L.sgd_objective_fit(df, ["a", "c"], "y", loss="squared_error", penalty="l2", alpha=0.01)
    Xs = X[:, [0, 2]]
    n = len(y)
    A = np.column_stack([Xs, np.ones(n)])
    reg = np.diag([0.01 * n, 0.01 * n, 0.0])
    ref = np.linalg.solve(A.T @ A + reg, A.T @ y)
    assert np.allclose(np.append(m.coef, m.intercept), ref, atol=1e-3)
