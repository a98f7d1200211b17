"""Linear-family regressors on the Gram core (G1) and distributed
loss/gradient aggregates (G2).

Every model is a :class:`LinearModel` — a feature-sized coefficient vector
scored as ONE column expression (``b + Σ w_j x_j``, optionally through an
``exp`` link), so prediction is a projection inside whole-stage codegen.
Fitting never moves rows to the driver: G1 models collect (p+1)² moments,
G2 models run one aggregate job per optimiser iteration.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import Moments, gram, total
from .optim import aggregate_objective, lbfgs


@dataclass
class LinearModel:
    features: list[str]
    coef: np.ndarray
    intercept: float
    link: str = "identity"
    extra: dict = field(default_factory=dict)

    def linear_expr(self) -> Column:
        eta = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.coef):
            if w != 0.0:
                eta = eta + F.lit(float(w)) * F.col(f).cast("double")
        return eta

    def expr(self) -> Column:
        eta = self.linear_expr()
        return F.exp(eta) if self.link == "log" else eta

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.expr())

    def predict_numpy(self, X: np.ndarray) -> np.ndarray:
        eta = X @ self.coef + self.intercept
        return np.exp(eta) if self.link == "log" else eta

    def to_dict(self) -> dict:
        return {
            "kind": "linear",
            "features": list(self.features),
            "coef": [float(v) for v in self.coef],
            "intercept": float(self.intercept),
            "link": self.link,
            "extra": self.extra,
        }

    @classmethod
    def from_dict(cls, d: dict) -> "LinearModel":
        return cls(list(d["features"]), np.array(d["coef"], dtype=float), float(d["intercept"]), d.get("link", "identity"), d.get("extra", {}))

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


def moments_of(df: DataFrame, features, target: str, weight=None) -> Moments:
    return total(gram(df, features, target, weight=weight))


def _from_coef(m: Moments, features, coef: np.ndarray, center: bool = True) -> LinearModel:
    _, _, _, xm, ym = m.parts()
    b = float(ym - xm @ coef) if center else 0.0
    return LinearModel(list(features), np.asarray(coef, dtype=float), b)


# ---------------------------------------------------------------- G1 solvers


def ols_from_moments(m: Moments, features) -> LinearModel:
    """Least squares with intercept; min-norm solution on rank loss."""
    G, c, _, _, _ = m.parts()
    coef = np.linalg.lstsq(G, c, rcond=None)[0]
    return _from_coef(m, features, coef)


def ridge_from_moments(m: Moments, features, alpha: float = 1.0) -> LinearModel:
    G, c, _, _, _ = m.parts()
    coef = np.linalg.solve(G + alpha * np.eye(len(c)), c) if len(c) else np.zeros(0)
    return _from_coef(m, features, coef)


def enet_from_moments(
    m: Moments, features, alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 1000, tol: float = 1e-4
) -> LinearModel:
    """Coordinate descent on the Gram for 1/(2n)‖r‖² + αρ‖w‖₁ + α(1−ρ)/2‖w‖²."""
    G, c, _, _, _ = m.parts()
    n = m.n
    p = len(c)
    w = np.zeros(p)
    l1 = n * alpha * l1_ratio
    l2 = n * alpha * (1.0 - l1_ratio)
    diag = np.diag(G).copy()
    for _ in range(max_iter * 10):
        w_max = 0.0
        d_max = 0.0
        for j in range(p):
            if diag[j] == 0:
                continue
            rho = c[j] - G[j] @ w + diag[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            d_max = max(d_max, abs(new - w[j]))
            w[j] = new
            w_max = max(w_max, abs(new))
        if w_max == 0.0 or d_max / w_max < tol * 1e-4:
            break
    return _from_coef(m, features, w)


def lars_from_moments(m: Moments, features, n_nonzero_coefs: int | None = 500, alpha: float | None = None) -> LinearModel:
    """LARS (or LASSO-LARS when ``alpha`` is given) in covariance form.

    Path steps use only the Gram, so the row data are never revisited.
    LARS stops after ``n_nonzero_coefs`` active features; LASSO-LARS drops
    a feature whose coefficient crosses zero and stops at ``alpha``
    (objective 1/(2n)‖r‖² + α‖w‖₁).
    """
    G, c, _, _, _ = m.parts()
    n = m.n
    p = len(c)
    w = np.zeros(p)
    active: list[int] = []
    max_active = min(p, n_nonzero_coefs if n_nonzero_coefs is not None else p)
    lasso = alpha is not None
    eps = 1e-12
    for _ in range(8 * p + 8):
        corr = c - G @ w
        inactive = [j for j in range(p) if j not in active]
        C = np.max(np.abs(corr)) if p else 0.0
        if lasso and C / n <= alpha + eps:
            break
        if not lasso and len(active) >= max_active:
            break
        if not active or (inactive and np.max(np.abs(corr[inactive])) >= C - 1e-10 * max(C, 1)):
            if inactive:
                j = max(inactive, key=lambda k: abs(corr[k]))
                if abs(corr[j]) <= eps:
                    break
                if j not in active:
                    active.append(j)
        A = active
        s = np.sign(corr[A])
        GA = G[np.ix_(A, A)]
        try:
            u = np.linalg.solve(GA, s)
        except np.linalg.LinAlgError:
            u = np.linalg.lstsq(GA, s, rcond=None)[0]
        denom = float(s @ u)
        if denom <= 0:
            break
        AA = 1.0 / np.sqrt(denom)
        direction = np.zeros(p)
        direction[A] = AA * u
        a = G @ direction  # correlation change per unit step
        CA = float(np.max(np.abs(corr[A])))
        gamma = CA / AA
        for j in range(p):
            if j in A:
                continue
            for num, den in ((CA - corr[j], AA - a[j]), (CA + corr[j], AA + a[j])):
                if den > eps:
                    g = num / den
                    if eps < g < gamma:
                        gamma = g
        if lasso:
            target = (CA - n * alpha) / AA
            gamma = min(gamma, max(target, 0.0))
        drop = None
        if lasso:
            for k in A:
                if direction[k] != 0:
                    g = -w[k] / direction[k]
                    if eps < g < gamma:
                        gamma, drop = g, k
        w = w + gamma * direction
        if drop is not None:
            w[drop] = 0.0
            active.remove(drop)
        if not lasso and len(active) >= min(max_active, p) and gamma == CA / AA:
            break
        if lasso and abs(CA - gamma * AA - n * alpha) <= 1e-10 * max(1.0, n * alpha):
            break
    if not lasso and len(active) >= p and p > 0:
        # full path ends at the least-squares fit
        return ols_from_moments(m, features)
    return _from_coef(m, features, w)


def bayesian_ridge_from_moments(m: Moments, features, max_iter: int = 300, tol: float = 1e-3) -> LinearModel:
    """Evidence maximisation of (α, λ) with the eigen-decomposed Gram."""
    G, c, yty, _, _ = m.parts()
    n = m.n
    p = len(c)
    a1 = a2 = l1 = l2 = 1e-6
    var_y = yty / n
    alpha_ = 1.0 / (var_y + np.finfo(float).eps)
    lambda_ = 1.0
    ev, V = np.linalg.eigh(G)
    ev = np.clip(ev, 0.0, None)
    if n <= p:  # keep the n largest like an economy SVD
        ev = ev[-int(n):]
        V = V[:, -int(n):]
    Vc = V.T @ c

    def update(alpha_, lambda_):
        coef = V @ (Vc / (ev + lambda_ / alpha_))
        rmse = float(yty - 2 * coef @ c + coef @ G @ coef)
        return coef, max(rmse, 0.0)

    coef_old = None
    for it in range(max_iter):
        coef, rmse = update(alpha_, lambda_)
        gamma = float(np.sum((alpha_ * ev) / (lambda_ + alpha_ * ev)))
        lambda_ = (gamma + 2 * l1) / (float(coef @ coef) + 2 * l2)
        alpha_ = (n - gamma + 2 * a1) / (rmse + 2 * a2)
        if coef_old is not None and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef.copy()
    coef, _ = update(alpha_, lambda_)
    model = _from_coef(m, features, coef)
    model.extra = {"alpha": alpha_, "lambda": lambda_}
    return model


def pls_from_moments(m: Moments, features, n_components: int = 1) -> LinearModel:
    """PLS1 (NIPALS, scaled) entirely in Gram form."""
    G, c, yty, _, _ = m.parts()
    n = m.n
    p = len(c)
    if not 1 <= n_components <= p:
        raise ValueError("n_components must be between 1 and the number of features.")
    x_std = np.sqrt(np.diag(G) / (n - 1))
    x_std[x_std == 0] = 1.0
    y_std = np.sqrt(yty / (n - 1)) or 1.0
    Gs = G / np.outer(x_std, x_std)
    cs = c / x_std / y_std
    W, P, Q = [], [], []
    for _ in range(n_components):
        norm = np.linalg.norm(cs)
        if norm == 0:
            break
        w = cs / norm
        Gw = Gs @ w
        tt = float(w @ Gw)
        if tt <= 0:
            break
        pl = Gw / tt
        q = float(cs @ w) / tt
        W.append(w)
        P.append(pl)
        Q.append(q)
        Gs = Gs - tt * np.outer(pl, pl)
        cs = cs - pl * float(cs @ w)
    W, P, Q = np.array(W).T, np.array(P).T, np.array(Q)
    coef_s = W @ np.linalg.pinv(P.T @ W) @ Q
    coef = coef_s * y_std / x_std
    return _from_coef(m, features, coef)


def kernel_ridge_linear_from_moments(m: Moments, features, alpha: float = 1.0) -> LinearModel:
    """Linear-kernel ridge without intercept: w = (XᵀX + αI)⁻¹Xᵀy (primal form)."""
    G, c, _, _, _ = m.parts(center=False)
    coef = np.linalg.solve(G + alpha * np.eye(len(c)), c)
    return LinearModel(list(features), coef, 0.0)


# ---------------------------------------------------------------- G2 solvers


def _eta(features, coef, b) -> Column:
    e = F.lit(float(b))
    for f, w in zip(features, coef):
        e = e + F.lit(float(w)) * F.col(f).cast("double")
    return e


def huber_fit(df: DataFrame, features, target: str, epsilon: float = 1.35, alpha: float = 1e-4, max_iter: int = 100) -> LinearModel:
    """Σ(σ + H_ε(r/σ)σ) + α‖w‖² jointly in (w, b, σ); σ = exp(u) keeps it positive."""
    if epsilon < 1.0:
        raise ValueError("epsilon must be greater than or equal to 1.0")
    p = len(features)
    y = F.col(target).cast("double")

    def build(theta):
        w, b, u = theta[:p], theta[p], theta[p + 1]
        sigma = float(np.exp(u))
        r = y - _eta(features, w, b)
        inl = F.abs(r) <= F.lit(epsilon * sigma)
        loss = F.sum(F.when(inl, r * r / sigma).otherwise(2 * epsilon * F.abs(r) - epsilon * epsilon * sigma))
        psi = F.when(inl, -2.0 * r / sigma).otherwise(-2.0 * epsilon * F.signum(r))
        grads = [F.sum(psi * F.col(f).cast("double")) for f in features] + [F.sum(psi)]
        dsig = F.sum(F.lit(1.0) - F.when(inl, r * r / (sigma * sigma)).otherwise(F.lit(epsilon * epsilon)))
        return loss, grads + [dsig]

    base = aggregate_objective(df, build)
    n = float(df.count())

    def fun(theta):
        f, g = base(theta)
        w, sigma = theta[:p], float(np.exp(theta[p + 1]))
        g = g.copy()
        g[:p] += 2 * alpha * w
        g[p + 1] *= sigma  # d/du with σ = exp(u)
        return f + n * sigma + alpha * float(w @ w), g

    # warm start: least squares from one Gram pass, σ from its residual std
    m = moments_of(df, features, target)
    start = ols_from_moments(m, features)
    G, c, yty, _, _ = m.parts()
    rss = max(float(yty - 2 * start.coef @ c + start.coef @ G @ start.coef), 1e-12)
    theta0 = np.concatenate([start.coef, [start.intercept], [0.5 * np.log(rss / max(m.n, 1.0))]])
    theta = lbfgs(fun, theta0, max_iter=max_iter, tol=1e-8)
    model = LinearModel(list(features), theta[:p], float(theta[p]))
    model.extra = {"scale": float(np.exp(theta[p + 1]))}
    return model


def tweedie_fit(df: DataFrame, features, target: str, power: float = 0.0, alpha: float = 1.0, max_iter: int = 100) -> LinearModel:
    """½·mean deviance + α/2‖w‖²; identity link for power ≤ 0, else log."""
    if 0 < power < 1:
        raise ValueError("power must not be in (0, 1)")
    p = len(features)
    if power <= 0:
        m = moments_of(df, features, target)
        G, c, _, _, _ = m.parts()
        coef = np.linalg.solve(G + m.n * alpha * np.eye(p), c)
        return _from_coef(m, features, coef)
    y = F.col(target).cast("double")
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")).first()
    n, ybar = float(stats["n"]), float(stats["m"])

    def dev(mu):
        if power == 1:
            return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0)) - y + mu)
        if power == 2:
            return 2 * (F.log(mu / y) + y / mu - 1)
        return 2 * (
            F.pow(F.greatest(y, F.lit(0.0)), 2 - power) / ((1 - power) * (2 - power))
            - y * F.pow(mu, 1 - power) / (1 - power)
            + F.pow(mu, 2 - power) / (2 - power)
        )

    def build(theta):
        mu = F.exp(_eta(features, theta[:p], theta[p]))
        loss = F.sum(dev(mu)) / (2 * n)
        gi = (mu - y) * F.pow(mu, 1 - power) / n
        return loss, [F.sum(gi * F.col(f).cast("double")) for f in features] + [F.sum(gi)]

    base = aggregate_objective(df, build)

    def fun(theta):
        f, g = base(theta)
        w = theta[:p]
        g = g.copy()
        g[:p] += alpha * w
        return f + 0.5 * alpha * float(w @ w), g

    theta0 = np.concatenate([np.zeros(p), [np.log(ybar)]])
    theta = lbfgs(fun, theta0, max_iter=max_iter, tol=1e-10)
    return LinearModel(list(features), theta[:p], float(theta[p]), link="log")


def sgd_objective_fit(
    df: DataFrame,
    features,
    target: str,
    loss: str = "squared_error",
    penalty: str = "l2",
    alpha: float = 1e-4,
    l1_ratio: float = 0.15,
    epsilon: float = 0.1,
    max_iter: int = 200,
) -> LinearModel:
    """The SGD regressor's regularised objective, minimised deterministically
    with full-batch distributed gradients (mean loss + α·penalty)."""
    p = len(features)
    y = F.col(target).cast("double")
    n = float(df.count())
    smooth = 1e-8

    def build(theta):
        r = y - _eta(features, theta[:p], theta[p])
        if loss == "squared_error":
            li, d = 0.5 * r * r, -r
        elif loss == "huber":
            small = F.abs(r) <= epsilon
            li = F.when(small, 0.5 * r * r).otherwise(epsilon * F.abs(r) - 0.5 * epsilon * epsilon)
            d = F.when(small, -r).otherwise(-epsilon * F.signum(r))
        elif loss == "epsilon_insensitive":
            li = F.greatest(F.abs(r) - epsilon, F.lit(0.0))
            d = F.when(F.abs(r) > epsilon, -F.signum(r)).otherwise(F.lit(0.0))
        else:
            raise ValueError(f"Unsupported loss: {loss}")
        return F.sum(li) / n, [F.sum(d * F.col(f).cast("double")) / n for f in features] + [F.sum(d) / n]

    base = aggregate_objective(df, build)

    def fun(theta):
        f, g = base(theta)
        w = theta[:p]
        g = g.copy()
        rho = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]
        soft = np.sqrt(w * w + smooth)
        f += alpha * ((1 - rho) * 0.5 * float(w @ w) + rho * float(soft.sum()))
        g[:p] += alpha * ((1 - rho) * w + rho * w / soft)
        return f, g

    start = ols_from_moments(moments_of(df, features, target), features)  # warm start
    theta = lbfgs(fun, np.concatenate([start.coef, [start.intercept]]), max_iter=max_iter, tol=1e-9)
    return LinearModel(list(features), theta[:p], float(theta[p]))


def quantile_fit(
    df: DataFrame, features, target: str, quantile: float = 0.5, alpha: float = 1.0, max_iter: int = 100, tol: float = 1e-7
) -> LinearModel:
    """mean pinball loss + α‖w‖₁ by majorise-minimise (IRLS): every round is
    one weighted Gram pass with weight 1/(2·max(|r|, δ)) and a closed solve."""
    p = len(features)
    y = F.col(target).cast("double")
    cols = list(features)
    base = total(gram(df, cols, target))
    n = base.n
    sums_x = base.s[:p] + n * base.shift[:p]
    sum_y = base.s[p] + n * base.shift[p]
    start = ols_from_moments(base, features)
    theta = np.concatenate([start.coef, [start.intercept]])
    delta = 1e-6 * max(1.0, float(np.sqrt(base.centered()[p, p] / n)))
    for _ in range(max_iter):
        r = y - _eta(features, theta[:p], theta[p])
        wcol = F.lit(0.5) / F.greatest(F.abs(r), F.lit(delta))
        mw = total(gram(df, cols, target, weight=wcol, shift=base.shift))
        U = mw.uncentered()
        sw = mw.s + mw.n * mw.shift  # Σ a z
        A = np.zeros((p + 1, p + 1))
        A[:p, :p] = U[:p, :p]
        A[:p, p] = A[p, :p] = sw[:p]
        A[p, p] = mw.n
        rhs = np.concatenate([U[:p, p], [sw[p]]]) + (quantile - 0.5) * np.concatenate([sums_x, [n]])
        D = np.zeros(p + 1)
        D[:p] = n * alpha / np.maximum(np.abs(theta[:p]), 1e-10)
        new = np.linalg.solve(A + np.diag(D), rhs)
        if np.max(np.abs(new - theta)) <= tol * max(1.0, np.max(np.abs(theta))):
            theta = new
            break
        theta = new
    theta[:p][np.abs(theta[:p]) < 1e-6] = 0.0
    return LinearModel(list(features), theta[:p], float(theta[p]))
