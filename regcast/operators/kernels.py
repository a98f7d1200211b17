"""Kernel models — N1. Exact by default (``kernel_exact``), explicit feature maps on request.

Without ``n_components`` and ``n_landmarks``, kernel_ridge, gaussian_process, svm
and nu_svr are solved on the kernel itself. Given either, the kernel becomes a
map φ with φ(x)·φ(z) ≈ K(x, z), applied to every row inside Arrow tasks:

* linear: the features themselves (exact);
* poly: all monomials up to the degree, with their multinomial weights
  (exact; refused above ``MAX_MONOMIALS`` of them);
* rbf: ``n_components`` random Fourier features, drawn from a fixed seed and
  independent of the data (the kernel's error falls with 1/√n_components);
* any kernel with ``n_landmarks``: Nyström features from that many rows picked
  by the seeded hash rank (exact when it covers all rows).

kernel_ridge / gaussian_process are ridge WITHOUT intercept on φ (the GP mean
with a fixed 1·RBF(1) kernel equals kernel ridge with γ = ½ and λ = alpha). svm /
nu_svr on a map minimise the primal ½‖w‖² + C·Σ loss by L-BFGS, the hinge
smoothed over a width of 1e-3·std(y); the exact dual has no smoothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations_with_replacement
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowopt import arrow_objective
from .gram import gram_mapped, total
from .optim import lbfgs
from .sampling import seeded_hash

MAX_MONOMIALS = 5000
SEED = 42


def kernel_matrix(A: np.ndarray, B: np.ndarray, kernel: str, gamma: float, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    if kernel == "linear":
        return A @ B.T
    if kernel == "rbf":
        d = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2 * A @ B.T
        return np.exp(-gamma * np.maximum(d, 0.0))
    if kernel == "poly":
        return (gamma * (A @ B.T) + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * (A @ B.T) + coef0)
    raise ValueError(f"Unsupported kernel: {kernel}")


@dataclass
class LandmarkMap:
    L: np.ndarray
    T: np.ndarray
    kernel: str
    gamma: float
    degree: int
    coef0: float

    def __call__(self, X: np.ndarray) -> np.ndarray:
        return kernel_matrix(np.asarray(X, dtype=float), self.L, self.kernel, self.gamma, self.degree, self.coef0) @ self.T

    @property
    def dim(self) -> int:
        return self.T.shape[1]

    def to_dict(self):
        return {"L": self.L.tolist(), "T": self.T.tolist(), "kernel": self.kernel, "gamma": self.gamma, "degree": self.degree, "coef0": self.coef0}

    @classmethod
    def from_dict(cls, d):
        return cls(np.array(d["L"]), np.array(d["T"]), d["kernel"], d["gamma"], d["degree"], d["coef0"])


def _landmarks(df: DataFrame, features, m: int) -> np.ndarray:
    key = "idx" if "idx" in df.columns else None
    src = df if key else df.withColumn("_lid", F.monotonically_increasing_id())
    h = seeded_hash([key or "_lid"])
    pdf = src.select(*features, h.alias("_h"), F.col(key or "_lid").alias("_k")).orderBy("_h", "_k").limit(m).toPandas()
    return pdf[list(features)].to_numpy(dtype=float)


def landmark_map(df, features, kernel, gamma, degree=3, coef0=0.0, n_landmarks=1000) -> LandmarkMap:
    L = _landmarks(df, features, int(n_landmarks))
    K = kernel_matrix(L, L, kernel, gamma, degree, coef0)
    lam, U = np.linalg.eigh((K + K.T) / 2)
    keep = lam > 1e-12 * max(lam.max(), 1e-300)
    T = U[:, keep] / np.sqrt(lam[keep])
    return LandmarkMap(L, T, kernel, float(gamma), int(degree), float(coef0))


@dataclass
class IdentityMap:
    dim: int

    def __call__(self, X: np.ndarray) -> np.ndarray:
        return np.asarray(X, dtype=float)

    def to_dict(self):
        return {"map": "identity", "dim": self.dim}


@dataclass
class MonomialMap:
    """(γ x·z + c)^d as a dot product: one feature for each multiset of d of the columns and the constant."""

    p: int
    gamma: float
    degree: int
    coef0: float

    def __post_init__(self):
        self.sets = [np.bincount(m, minlength=self.p + 1) for m in combinations_with_replacement(range(self.p + 1), self.degree)]
        self.weight = np.array([np.sqrt(factorial(self.degree) / np.prod([factorial(int(k)) for k in m])) for m in self.sets])

    def __call__(self, X: np.ndarray) -> np.ndarray:
        Z = np.column_stack([np.sqrt(self.gamma) * np.asarray(X, dtype=float), np.full(len(X), np.sqrt(self.coef0))])
        return np.column_stack([np.prod(Z**m, axis=1) for m in self.sets]) * self.weight

    @property
    def dim(self) -> int:
        return len(self.sets)

    def to_dict(self):
        return {"map": "monomials", "p": self.p, "gamma": self.gamma, "degree": self.degree, "coef0": self.coef0}


@dataclass
class FourierMap:
    """Random Fourier features of exp(-γ‖x - z‖²): cosines and sines of seeded Gaussian directions."""

    p: int
    gamma: float
    n_components: int
    seed: int = SEED

    def __post_init__(self):
        self.W = np.random.RandomState(self.seed).normal(scale=np.sqrt(2 * self.gamma), size=(self.p, self.n_components // 2))

    def __call__(self, X: np.ndarray) -> np.ndarray:
        z = np.asarray(X, dtype=float) @ self.W
        return np.column_stack([np.cos(z), np.sin(z)]) / np.sqrt(self.W.shape[1])

    @property
    def dim(self) -> int:
        return 2 * self.W.shape[1]

    def to_dict(self):
        return {"map": "fourier", "p": self.p, "gamma": self.gamma, "n_components": self.n_components, "seed": self.seed}


MAPS = {"identity": IdentityMap, "monomials": MonomialMap, "fourier": FourierMap}


def map_from_dict(d: dict):
    if "map" not in d:
        return LandmarkMap.from_dict(d)
    if d["map"] == "pivots":
        from .kernel_exact import PivotMap

        return PivotMap.from_dict(d)
    return MAPS[d["map"]](**{k: v for k, v in d.items() if k != "map"})


def feature_map(df, features, kernel, gamma, degree=3, coef0=0.0, n_components=None, n_landmarks=None):
    p = len(features)
    if n_landmarks is not None:
        return landmark_map(df, features, kernel, gamma, degree, coef0, n_landmarks)
    if kernel == "linear":
        return IdentityMap(p)
    if kernel == "poly":
        if gamma < 0 or coef0 < 0 or comb(p + degree, degree) > MAX_MONOMIALS:
            raise ValueError("This polynomial kernel has no small explicit map; give n_landmarks.")
        return MonomialMap(p, float(gamma), int(degree), float(coef0))
    if kernel == "rbf":
        return FourierMap(p, float(gamma), int(n_components))
    if kernel == "sigmoid":
        raise ValueError("The sigmoid kernel has no explicit map; give n_landmarks.")
    raise ValueError(f"Unsupported kernel: {kernel}")


def _gamma(df, features, gamma, kernel_default: str):
    if isinstance(gamma, (int, float)):
        return float(gamma)
    p = len(features)
    if gamma == "auto" or gamma is None:
        return 1.0 / p
    if gamma == "scale":
        # 1 / (p · Var(X)) with the variance over all entries of X
        r = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)],
            *[F.sum(F.col(f).cast("double") ** 2).alias(f"q{i}") for i, f in enumerate(features)],
        ).first()
        N = r["n"] * p
        mean = sum(r[f"s{i}"] for i in range(p)) / N
        var = sum(r[f"q{i}"] for i in range(p)) / N - mean * mean
        return 1.0 / (p * var) if var > 0 else 1.0
    raise ValueError(f"Unsupported gamma: {gamma}")


@dataclass
class KernelModel:
    features: list
    fmap: object
    w: np.ndarray
    b: float = 0.0
    extra: dict = field(default_factory=dict)

    def predict_numpy(self, X: np.ndarray) -> np.ndarray:
        return self.fmap(X) @ self.w + self.b

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        model = self
        feats = list(self.features)

        @F.pandas_udf("double")
        def score(cols: pd.DataFrame) -> pd.Series:
            return pd.Series(model.predict_numpy(cols[feats].to_numpy(dtype=float)))

        return df.withColumn(output, score(F.struct(*[F.col(c).cast("double").alias(c) for c in feats])))

    def to_dict(self):
        return {"kind": "kernel", "class": "regcast.operators.kernels.KernelModel", "features": self.features,
                "fmap": self.fmap.to_dict(), "w": self.w.tolist(), "b": self.b, "extra": self.extra}

    @classmethod
    def from_dict(cls, d):
        return cls(d["features"], map_from_dict(d["fmap"]), np.array(d["w"]), d["b"], d.get("extra", {}))

    def to_json(self):
        return json.dumps(self.to_dict())


def _ridge_no_intercept(df, features, target, fmap, alpha: float) -> KernelModel:
    m = total(gram_mapped(df, features, target, fmap, fmap.dim))
    S = m.uncentered()
    r = fmap.dim
    lam, U = np.linalg.eigh(S[:r, :r])  # φ may have more columns than rows: directions without data get no weight
    keep = lam > 1e-13 * max(lam.max(), 1e-300)
    w = U[:, keep] @ ((U[:, keep].T @ S[:r, r]) / (lam[keep] + alpha))
    return KernelModel(list(features), fmap, w, 0.0)


def _exact(n_components, n_landmarks) -> bool:
    return n_components is None and n_landmarks is None


def kernel_ridge_fit(df, features, target, alpha=1.0, kernel="linear", gamma=None, degree=3, coef0=1.0, n_components=None, n_landmarks=None, **_):
    """Exact for every kernel; the sigmoid kernel, which is not positive definite, needs ``n_landmarks``."""
    g = 1.0 / len(features) if gamma is None else float(gamma)
    if kernel in ("rbf", "poly") and _exact(n_components, n_landmarks):
        from .kernel_exact import Kernel, solve_ridge

        return solve_ridge(df, features, target, Kernel(kernel, g, int(degree), float(coef0)), float(alpha))
    fmap = feature_map(df, features, kernel, g, int(degree), float(coef0), n_components, n_landmarks)
    return _ridge_no_intercept(df, features, target, fmap, float(alpha))


def gaussian_process_fit(df, features, target, alpha=1e-10, n_components=None, n_landmarks=None, **_):
    if _exact(n_components, n_landmarks):
        from .kernel_exact import Kernel, solve_ridge

        return solve_ridge(df, features, target, Kernel("rbf", 0.5), float(alpha))
    fmap = feature_map(df, features, "rbf", 0.5, n_components=n_components, n_landmarks=n_landmarks)
    return _ridge_no_intercept(df, features, target, fmap, float(alpha))


def _smooth_eps_loss(r: np.ndarray, eps: float, delta: float):
    a = np.abs(r) - eps
    loss = np.where(a <= 0, 0.0, np.where(a <= delta, a * a / (2 * delta), a - delta / 2))
    d = np.where(a <= 0, 0.0, np.where(a <= delta, a / delta, 1.0)) * np.sign(r)  # d loss / d r
    return loss, d, np.where(a <= 0, 0.0, np.where(a <= delta, a / delta, 1.0))


def _svr(df, features, target, C, epsilon, nu, kernel, degree, gamma, coef0, n_components, n_landmarks, max_iter):
    g = _gamma(df, features, gamma, kernel)
    if _exact(n_components, n_landmarks):
        from .kernel_exact import Kernel, solve_svr

        return solve_svr(df, features, target, Kernel(kernel, g, degree, coef0), C, epsilon, nu, max_iter)
    max_iter = min(max_iter, 200)
    fmap = feature_map(df, features, kernel, g, degree, coef0, n_components, n_landmarks)
    r = fmap.dim
    ystd = float(df.agg(F.stddev_pop(F.col(target).cast("double"))).first()[0] or 1.0)
    delta = 1e-3 * ystd
    n = df.count()

    def partial(X, y, th):
        P = fmap(X)
        w, b = th[:r], th[r]
        eps = th[r + 1] ** 2 if nu is not None else epsilon
        res = y - (P @ w + b)
        loss, d, dabs = _smooth_eps_loss(res, eps, delta)
        grad = np.zeros_like(th)
        grad[:r] = -(P.T @ d)
        grad[r] = -d.sum()
        if nu is not None:
            grad[r + 1] = -(dabs.sum()) * 2 * th[r + 1]
        return float(loss.sum()), grad

    base = arrow_objective(df, features, target, partial)

    def fun(th):
        f, gr = base(th)
        w = th[:r]
        f = 0.5 * float(w @ w) + C * f
        gr = gr * C
        gr[:r] += w
        if nu is not None:
            f += C * nu * n * th[r + 1] ** 2
            gr[r + 1] += C * nu * n * 2 * th[r + 1]
        return f / n, gr / n  # the same minimum, on a scale that does not grow with the rows

    th0 = np.zeros(r + (2 if nu is not None else 1))
    th0[r] = float(df.agg(F.avg(F.col(target).cast("double"))).first()[0])
    if nu is not None:
        th0[r + 1] = np.sqrt(max(epsilon, 1e-6))
    th = lbfgs(fun, th0, max_iter=max_iter, tol=1e-9)
    model = KernelModel(list(features), fmap, th[:r], float(th[r]))
    model.extra = {"epsilon": float(th[r + 1] ** 2) if nu is not None else float(epsilon), "smoothing": delta}
    return model


def svr_fit(df, features, target, kernel="rbf", C=1.0, epsilon=0.1, degree=3, gamma="scale", coef0=0.0, n_components=None, n_landmarks=None, max_iter=2000, **_):
    return _svr(df, features, target, float(C), float(epsilon), None, kernel, int(degree), gamma, float(coef0), n_components, n_landmarks, max_iter)


def nu_svr_fit(df, features, target, nu=0.5, C=1.0, kernel="rbf", degree=3, gamma="scale", coef0=0.0, n_components=None, n_landmarks=None, max_iter=2000, **_):
    if not 0 < nu <= 1:
        raise ValueError("nu must be in (0, 1].")
    return _svr(df, features, target, float(C), 0.1, float(nu), kernel, int(degree), gamma, float(coef0), n_components, n_landmarks, max_iter)
