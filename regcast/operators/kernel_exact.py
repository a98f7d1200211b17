"""Exact kernel models: no landmarks, no random features, the kernel matrix never stored.

Ridge and Gaussian process (K + αI)a = y:

1. Randomly pivoted Cholesky. A pass over the rows finds each row's residual
   k(x,x) - ‖φ(x)‖² under the pivots so far; rows are drawn in proportion to it
   (seeded hash keys, a bounded number per task), and the driver factors the
   drawn ones. Where every residual falls below the tolerance, φ reproduces
   the kernel to rounding, and ridge on φ is the exact solution.
2. Where ``MAX_RANK`` pivots do not reach that, conjugate gradients solve the dual
   system, preconditioned by φ (Woodbury). Each product K·v is a job over row
   blocks; a task computes one block of K at a time and drops it.

Support vector machines: over the pivots by Newton steps (kernel_newton), where these
reproduce a positive semidefinite kernel and there are more than ``DIRECT_ROWS``
rows. Elsewhere the dual by block coordinate descent. The driver
picks the most violating variables, their kernel columns come from one job per
block of rows, a working-set solver moves them, and the next job updates K·β.
It stops at libsvm's optimality tolerance; the relative duality gap is kept.

Exact kernels cost O(n²) evaluations, and the training rows are the model. The
rows and vectors of length n are broadcast; more than ``MAX_CELLS`` numbers are
refused (set n_landmarks or n_components there). Over pivots no rows are broadcast, and
the model is the pivots.
"""

from __future__ import annotations

import base64
import json
import warnings
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SEED = 42
MAX_RANK = 4096  # pivots; their triangular factor is on the driver
DRAWN = 384  # rows drawn per pass
MAX_CELLS = 64_000_000  # numbers of the training rows that a broadcast may hold
BLOCK = 1024  # rows of a kernel block
STRIPE = 256  # rows of the Gram matrix in one cell of its sum


@dataclass
class Kernel:
    name: str
    gamma: float
    degree: int = 3
    coef0: float = 0.0

    def __call__(self, A: np.ndarray, B: np.ndarray) -> np.ndarray:
        from .kernels import kernel_matrix

        return kernel_matrix(A, B, self.name, self.gamma, self.degree, self.coef0)

    @property
    def definite(self) -> bool:
        """Whether no choice of rows gives its matrix a negative eigenvalue."""
        return self.name == "linear" or (self.gamma >= 0 and (self.name == "rbf" or (self.name == "poly" and self.coef0 >= 0)))

    def diagonal(self, A: np.ndarray) -> np.ndarray:
        dot = (A * A).sum(axis=1)
        return {"rbf": np.ones(len(A)), "linear": dot, "poly": (self.gamma * dot + self.coef0) ** self.degree, "sigmoid": np.tanh(self.gamma * dot + self.coef0)}[self.name]


def _pack(a: np.ndarray) -> str:
    return base64.b64encode(zlib.compress(np.ascontiguousarray(a, dtype=float).tobytes(), 1)).decode()


def _unpack(text: str, *shape: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(base64.b64decode(text)), dtype=float).reshape(shape)


@dataclass
class PivotMap:
    """φ(x) = L⁻¹ k(pivots, x): φ(x)·φ(z) is the kernel on the span of the pivots."""

    pivots: np.ndarray
    inverse: np.ndarray  # L⁻¹, lower triangular
    kernel: Kernel

    def __call__(self, X: np.ndarray) -> np.ndarray:
        return self.kernel(np.asarray(X, dtype=float), self.pivots) @ self.inverse.T

    @property
    def dim(self) -> int:
        return len(self.pivots)

    def to_dict(self):
        m, p = self.pivots.shape
        return {"map": "pivots", "m": m, "p": p, "pivots": _pack(self.pivots), "inverse": _pack(self.inverse), "kernel": vars(self.kernel)}

    @classmethod
    def from_dict(cls, d):
        return cls(_unpack(d["pivots"], d["m"], d["p"]), _unpack(d["inverse"], d["m"], d["m"]), Kernel(**d["kernel"]))


@dataclass
class KernelDualModel:
    """f(x) = Σ a_i k(x_i, x) + b over the training rows with a weight, or over pivots."""

    features: list
    X: np.ndarray
    a: np.ndarray
    b: float
    kernel: Kernel
    extra: dict = field(default_factory=dict)

    @property
    def w(self) -> np.ndarray:
        """The weights of the features; only a linear kernel has them."""
        if self.kernel.name != "linear":
            raise AttributeError(f"A model on the {self.kernel.name} kernel has no feature weights.")
        return self.a @ self.X

    def predict_numpy(self, X: np.ndarray) -> np.ndarray:
        X = np.asarray(X, dtype=float)
        out = np.full(len(X), self.b)
        for i in range(0, len(X), BLOCK):
            for j in range(0, len(self.X), 4 * BLOCK):
                out[i : i + BLOCK] += self.kernel(X[i : i + BLOCK], self.X[j : j + 4 * BLOCK]) @ self.a[j : j + 4 * BLOCK]
        return out

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        feats = list(self.features)
        model = df.sparkSession.sparkContext.broadcast(self)  # at most MAX_CELLS numbers

        @F.pandas_udf("double")
        def score(cols: pd.DataFrame) -> pd.Series:
            return pd.Series(model.value.predict_numpy(cols[feats].to_numpy(dtype=float)))

        return df.withColumn(output, score(F.struct(*[F.col(c).cast("double").alias(c) for c in feats])))

    def to_dict(self):
        return {"kind": "kernel_dual", "class": "regcast.operators.kernel_exact.KernelDualModel", "features": self.features, "n": len(self.X),
                "X": _pack(self.X), "a": _pack(self.a), "b": self.b, "kernel": vars(self.kernel), "extra": self.extra}

    @classmethod
    def from_dict(cls, d):
        return cls(d["features"], _unpack(d["X"], d["n"], len(d["features"])), _unpack(d["a"], d["n"]), d["b"], Kernel(**d["kernel"]), d.get("extra", {}))

    def to_json(self):
        return json.dumps(self.to_dict())


def _table(df: DataFrame, features, target: str) -> DataFrame:
    """x0.., y and a row id, dealt evenly over the cores; no row is left on the driver."""
    rid = F.col("idx").cast("long") if "idx" in df.columns else F.xxhash64(*[F.col(f) for f in features], F.col(target))
    cols = [F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    data = df.select(*cols, F.col(target).cast("double").alias("y"), rid.alias("_rid"))
    return materialize(data.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())))


def _weighted(data: DataFrame, p: int) -> DataFrame:
    """The column ``w`` added: 1, or in a large table the number of rows with equal features, merged to their mean target.

    A squared loss sees no more of them, so the solution is that of all rows.
    """
    from .trees import _merged

    names = [f"x{j}" for j in range(p)]
    merged = _merged(data.withColumnRenamed("y", "_y"), names, data.count())
    if merged is None:
        return data.withColumn("w", F.lit(1.0))
    few = merged[0].select(*names, F.col("_y").alias("y"), "_rid", F.col("_many").alias("w"))
    return materialize(few.repartition(data.sparkSession.sparkContext.defaultParallelism))


def _x(b, p: int) -> np.ndarray:
    return np.column_stack([b.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(p)]).astype(float)


def _draw_rows(data: DataFrame, p: int, kernel: Kernel, fmap: PivotMap | None, seed: int) -> tuple[np.ndarray, float, float, float]:
    """Rows drawn in proportion to their residual; the largest residual and diagonal of all rows, and the rounding (a residual below 0)."""
    from .trees import _mix

    sent = data.sparkSession.sparkContext.broadcast(fmap)

    def run(batches):
        keep, most, scale, noise = [], 0.0, 0.0, 0.0
        for b in batches:
            X, rid = _x(b, p), b.column("_rid").to_numpy(zero_copy_only=False)
            for a in range(0, len(X), BLOCK):
                part = X[a : a + BLOCK]
                rest = kernel.diagonal(part)
                scale = max(scale, float(rest.max(initial=0.0)))
                if sent.value is not None:
                    rest = rest - (sent.value(part) ** 2).sum(axis=1)
                most, noise = max(most, float(rest.max(initial=0.0))), max(noise, float(-rest.min(initial=0.0)))
                u = ((_mix(rid[a : a + BLOCK].astype(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
                keep.append(np.column_stack([-np.log(u) / np.maximum(rest, 1e-300), part]))
            if keep:
                found = np.concatenate(keep)
                keep = [found[np.argsort(found[:, 0], kind="stable")[:DRAWN]]]
        rows = keep[0] if keep else np.empty((0, p + 1))
        yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([scale]), pa.array([noise]), pa.array([len(rows)]), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], names=["most", "scale", "noise", "n", "rows"])

    found = data.mapInArrow(run, "most double, scale double, noise double, n long, rows binary").collect()
    rows = np.concatenate([np.frombuffer(r["rows"], dtype=float).reshape(r["n"], p + 1) for r in found])
    rows = np.unique(rows[np.lexsort(rows.T[::-1])][:DRAWN, 1:], axis=0)  # equal rows would repeat a pivot
    return rows, *(max(r[c] for r in found) for c in ("most", "scale", "noise"))


def pivot_map(data: DataFrame, p: int, kernel: Kernel, tol: float) -> tuple[PivotMap | None, bool]:
    """Pivots until every residual is at most ``tol`` (relative to the diagonal): the map, and whether that was reached."""
    fmap, seed = None, SEED
    while True:
        rows, most, scale, noise = _draw_rows(data, p, kernel, fmap, seed)
        least = max(tol * scale, 8 * noise)
        if most <= least:
            return fmap, True
        if fmap is not None and fmap.dim >= MAX_RANK:
            return fmap, False
        seed += 1
        rows = rows[: MAX_RANK - (fmap.dim if fmap else 0)]
        phi = fmap(rows) if fmap else np.zeros((len(rows), 0))
        R = kernel(rows, rows) - phi @ phi.T
        # Cholesky of the drawn rows' residuals, the largest first
        chosen: list[int] = []
        L = np.zeros((len(rows), len(rows)))
        left = np.diag(R).copy()
        while len(chosen) < len(rows):
            i = int(np.argmax(left))
            if left[i] <= least:
                break
            k = len(chosen)
            column = (R[:, i] - L[:, :k] @ L[i, :k]) / np.sqrt(left[i])
            L[:, k] = column
            left = left - column**2
            left[i] = -np.inf
            chosen.append(i)
        if not chosen:  # what is left is rounding
            return fmap, True
        Lc = L[chosen][:, : len(chosen)]
        inv = np.linalg.inv(np.tril(Lc))
        m = fmap.dim if fmap else 0
        inverse = np.zeros((m + len(chosen), m + len(chosen)))
        if fmap:
            inverse[:m, :m] = fmap.inverse
            inverse[m:, :m] = -inv @ (phi[chosen] @ fmap.inverse)
        inverse[m:, m:] = np.tril(inv)
        fmap = PivotMap(np.concatenate([fmap.pivots, rows[chosen]]) if fmap else rows[chosen], inverse, kernel)


def _gram(data: DataFrame, p: int, fmap: PivotMap, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """ΦᵀWΦ and ΦᵀWy (W the rows' weights, or 1): tasks return stripes of their sums as binary cells, Spark adds them stripe by stripe."""
    m = fmap.dim
    sent = data.sparkSession.sparkContext.broadcast(fmap)

    def run(batches):
        total = np.zeros((m, m + 1))
        for b in batches:
            X, y = _x(b, p), b.column("y").to_numpy(zero_copy_only=False)
            w = b.column("w").to_numpy(zero_copy_only=False) if weighted else np.ones(len(y))
            for a in range(0, len(X), BLOCK):
                phi = sent.value(X[a : a + BLOCK])
                total += (phi * w[a : a + BLOCK, None]).T @ np.column_stack([phi, y[a : a + BLOCK]])
        for i in range(0, m, STRIPE):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i : i + STRIPE].tobytes()], pa.binary())], names=["i", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), dtype=float) for c in table["cells"])
        return pa.Table.from_arrays([table["i"][:1].combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["i", "cells"])

    stripes = data.mapInArrow(run, "i long, cells binary").groupBy("i").applyInArrow(add, "i long, cells binary").collect()
    out = np.concatenate([np.frombuffer(r["cells"], dtype=float).reshape(-1, m + 1) for r in sorted(stripes, key=lambda r: r["i"])])
    return out[:, :m], out[:, m]


class KernelRows:
    """The training rows, broadcast, and products with their kernel matrix by jobs over row blocks."""

    def __init__(self, data: DataFrame, p: int, kernel: Kernel):
        n = data.count()
        if n * (p + 4) > MAX_CELLS:
            raise ValueError(f"An exact kernel on {n} rows needs {n}² evaluations a step; set n_landmarks or n_components.")
        pdf = data.toPandas().sort_values("_rid", kind="stable")
        self.X, self.y, self.n, self.kernel = pdf[[f"x{j}" for j in range(p)]].to_numpy(), pdf["y"].to_numpy(), n, kernel
        self.w = pdf["w"].to_numpy() if "w" in pdf else np.ones(n)
        self.spark = data.sparkSession
        self.sent = self.spark.sparkContext.broadcast(self.X)
        self.parts = min(-(-n // BLOCK), 4 * self.spark.sparkContext.defaultParallelism)

    def _by_block(self, work) -> np.ndarray:
        """work(rows) of every block of rows, put together in order."""

        def run(batches):
            for b in batches:
                for i in b.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.ascontiguousarray(work(i)).tobytes()], pa.binary())], names=["id", "v"])

        blocks = self.spark.range(0, -(-self.n // BLOCK), 1, max(1, self.parts)).mapInArrow(run, "id long, v binary").collect()
        return np.concatenate([np.frombuffer(r["v"], dtype=float) for r in sorted(blocks, key=lambda r: r["id"])])

    def times(self, v: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """K[:, columns] @ v."""
        sent, kernel = self.sent, self.kernel
        v_sent = self.spark.sparkContext.broadcast((v, columns))

        def work(i):
            X, (v, columns) = sent.value, v_sent.value
            mine, others = X[i * BLOCK : (i + 1) * BLOCK], X if columns is None else X[columns]
            out = np.zeros(len(mine))
            for j in range(0, len(others), 4 * BLOCK):
                out += kernel(mine, others[j : j + 4 * BLOCK]) @ v[j : j + 4 * BLOCK]
            return out

        out = self._by_block(work)
        v_sent.destroy()
        return out

    def mapped(self, fmap: PivotMap, c: np.ndarray) -> np.ndarray:
        """Φ @ c."""
        sent = self.sent
        return self._by_block(lambda i: fmap(sent.value[i * BLOCK : (i + 1) * BLOCK]) @ c)

    def projected(self, fmap: PivotMap, r: np.ndarray) -> np.ndarray:
        """Φᵀ r."""
        sent = self.sent
        parts = self._by_block(lambda i: fmap(sent.value[i * BLOCK : (i + 1) * BLOCK]).T @ r[i * BLOCK : (i + 1) * BLOCK])
        return parts.reshape(-1, fmap.dim).sum(axis=0)


def solve_ridge(df: DataFrame, features, target: str, kernel: Kernel, alpha: float, max_iter: int = 500, tol: float = 1e-10):
    """(K + αW⁻¹)a = y without an intercept, exact: a linear model on the pivots' map, or the dual over all rows.

    W holds the rows that each one stands for (``_weighted``), so it is 1 unless equal rows were merged.
    """
    from .kernels import KernelModel

    p = len(features)
    data = _weighted(_table(df, features, target), p)
    fmap, complete = pivot_map(data, p, kernel, max(1e-13, min(1e-10, 1e-3 * alpha)))
    if fmap is None:  # a kernel that is zero everywhere
        return KernelModel(list(features), _zero_map(p, kernel), np.zeros(1), 0.0)
    S, s = _gram(data, p, fmap)
    lam, U = np.linalg.eigh((S + S.T) / 2)
    lam = np.maximum(lam, 0.0)
    if complete:
        w = U @ ((U.T @ s) / (lam + alpha)) if alpha > 0 else U[:, lam > 1e-13 * lam.max()] @ ((U.T @ s)[lam > 1e-13 * lam.max()] / lam[lam > 1e-13 * lam.max()])
        return KernelModel(list(features), fmap, w, 0.0, {"rank": fmap.dim})
    rows = KernelRows(data, p, kernel)
    # the preconditioner ΦΦᵀ + δI, with δ the mean of what the pivots leave and α
    if (rows.w != 1).any():
        S, _ = _gram(data, p, fmap, weighted=False)
        lam, U = np.linalg.eigh((S + S.T) / 2)
        lam = np.maximum(lam, 0.0)
    noise = alpha / rows.w
    delta = float(noise.mean()) + max((float(kernel.diagonal(rows.X).sum()) - float(np.trace(S))) / rows.n, 1e-12)

    def precondition(r: np.ndarray) -> np.ndarray:
        u = rows.projected(fmap, r)
        return (r - rows.mapped(fmap, U @ ((U.T @ u) / (lam + delta)))) / delta

    a, r = np.zeros(rows.n), rows.y.copy()
    z = precondition(r)
    d, rz = z.copy(), float(r @ z)
    goal = tol * float(np.linalg.norm(rows.y))
    steps = 0
    while np.linalg.norm(r) > goal:
        if steps == max_iter:
            warnings.warn(f"Conjugate gradients stopped after {max_iter} steps at a relative residual of {np.linalg.norm(r) / np.linalg.norm(rows.y):.1e}.", stacklevel=2)
            break
        q = rows.times(d) + noise * d
        step = rz / float(d @ q)
        a, r = a + step * d, r - step * q
        z = precondition(r)
        rz, last = float(r @ z), rz
        d = z + rz / last * d
        steps += 1
    return KernelDualModel(list(features), rows.X, a, 0.0, kernel, {"steps": steps, "rank": fmap.dim})


def _zero_map(p: int, kernel: Kernel) -> PivotMap:
    return PivotMap(np.zeros((1, p)), np.zeros((1, 1)), kernel)


# ------------------------------------------------- support vector regression

WORKING_SET = 512
DIRECT_ROWS = 2048  # up to so many rows a few working sets solve the dual
TOLERANCE = 1e-3  # libsvm's stopping tolerance on the violation


def _violations(v: np.ndarray, up: np.ndarray, low: np.ndarray) -> tuple[float, float]:
    """The largest value that may still rise and the smallest that may still fall."""
    return float(v[up].max()) if up.any() else -np.inf, float(v[low].min()) if low.any() else np.inf


def _solve_working_set(Q: np.ndarray, grad: np.ndarray, a: np.ndarray, sign: np.ndarray, group: np.ndarray, C: float, tol: float, max_steps: int) -> np.ndarray:
    """Pairwise steps on a dense subproblem; each pair keeps Σ sign·a of its group (second-order choice of the partner)."""
    a, grad = a.copy(), grad.copy()
    diagonal = np.diag(Q)
    for _ in range(max_steps):
        v = -sign * grad
        up = ((sign > 0) & (a < C)) | ((sign < 0) & (a > 0))
        low = ((sign > 0) & (a > 0)) | ((sign < 0) & (a < C))
        best = None
        for g in np.unique(group):
            u, lo = up & (group == g), low & (group == g)
            if not u.any() or not lo.any():
                continue
            i = int(np.argmax(np.where(u, v, -np.inf)))
            gap = v[i] - v
            if gap[lo].max() > tol and (best is None or gap[lo].max() > best[0]):
                curve = np.maximum(diagonal[i] + diagonal - 2 * sign[i] * sign * Q[i], 1e-12)
                j = int(np.argmax(np.where(lo & (gap > 0), gap * gap / curve, -np.inf)))
                best = (gap[lo].max(), i, j, gap[j] / curve[j])
        if best is None:
            break
        _, i, j, step = best
        # a_i moves by sign_i * step, a_j by -sign_j * step, both kept in [0, C]
        room = (C - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else C - a[j])
        step = min(step, *room)
        if step <= 0:
            break
        for k, move in ((i, sign[i] * step), (j, -sign[j] * step)):
            a[k] = min(max(a[k] + move, 0.0), C)
            grad += Q[:, k] * move
    return a


def solve_svr(df: DataFrame, features, target: str, kernel: Kernel, C: float, epsilon: float, nu: float | None, max_iter: int = 2000, tol: float = TOLERANCE) -> KernelDualModel:
    """ε-SVR, or ν-SVR where ``nu`` is given, on the exact kernel.

    Variables a⁺, a⁻ in [0, C], β = a⁺ - a⁻. ε-SVR keeps Σβ = 0; ν-SVR keeps
    Σa⁺ = Σa⁻ = C·ν·n/2, so pairs stay within one sign. ``extra`` holds the
    relative duality gap, the violation and the number of steps.
    """
    p = len(features)
    data = _table(df, features, target)
    if kernel.definite and (n := data.count()) > DIRECT_ROWS:
        from .kernel_newton import newton_svr

        model = newton_svr(data, n, features, kernel, C, epsilon, nu, max_iter, tol)
        if model is not None:
            return model
    rows = KernelRows(data, p, kernel)
    n, y = rows.n, rows.y
    sign = np.concatenate([np.ones(n), -np.ones(n)])
    group = np.zeros(2 * n, dtype=int) if nu is None else (sign < 0).astype(int)
    cost = epsilon if nu is None else 0.0
    if nu is None:
        a, product = np.zeros(2 * n), np.zeros(n)
    else:
        full = np.clip(C * nu * n / 2 - C * np.arange(n), 0.0, C)
        a, product = np.concatenate([full, full]), np.zeros(n)
    steps = 0
    while True:
        grad = np.concatenate([product - y, y - product]) + cost
        v = -sign * grad  # ε-SVR: y - f -+ ε; ν-SVR: y - f
        up = ((sign > 0) & (a < C)) | ((sign < 0) & (a > 0))
        low = ((sign > 0) & (a > 0)) | ((sign < 0) & (a < C))
        ends = [_violations(v, up & (group == g), low & (group == g)) for g in np.unique(group)]
        violation = max(hi - lo for hi, lo in ends)
        if violation <= tol or steps >= max_iter:
            break
        share = WORKING_SET // (2 * len(ends))
        chosen = []
        for g in np.unique(group):
            for side, order in ((up, -v), (low, v)):
                mine = np.flatnonzero(side & (group == g))
                chosen.append(mine[np.argsort(order[mine], kind="stable")[:share]])
        W = np.unique(np.concatenate(chosen))
        at = W % n
        K = kernel(rows.X[at], rows.X[at])
        new = _solve_working_set(sign[W][:, None] * sign[W] * K, grad[W], a[W], sign[W], group[W], C, min(tol, violation / 10), 20 * WORKING_SET)
        moved = sign[W] * (new - a[W])
        if not moved.any():
            break
        a[W] = new
        columns, slot = np.unique(at, return_inverse=True)
        product = product + rows.times(np.bincount(slot, weights=moved), columns)
        steps += 1
    if violation > tol:
        warnings.warn(f"The dual stopped after {steps} steps at a violation of {violation:.1e}.", stacklevel=2)
    mids = [(hi + lo) / 2 if np.isfinite(hi) and np.isfinite(lo) else (hi if np.isfinite(hi) else lo) for hi, lo in ends]
    b = float(np.mean(mids)) if nu is not None else float(mids[0])
    eps = float((mids[0] - mids[1]) / 2) if nu is not None else epsilon
    beta = a[:n] - a[n:]
    norm = float(beta @ product)
    slack = np.maximum(np.abs(y - product - b) - eps, 0.0).sum()
    primal = 0.5 * norm + C * (slack + (nu * n * eps if nu is not None else 0.0))
    dual = -0.5 * norm + float(y @ beta) - (epsilon * a.sum() if nu is None else 0.0)
    gap = (primal - dual) / max(abs(primal), abs(dual), 1e-300)
    used = beta != 0
    return KernelDualModel(list(features), rows.X[used], beta[used], b, kernel, {"epsilon": eps, "gap": float(gap), "violation": float(violation), "steps": steps})
