"""G1: weighted moment (Gram) tables from one distributed pass.

For feature columns x (p of them), target y and an optional weight w the
pass returns, per group (e.g. fold), the *shifted* raw sums

    n = Σw,  s = Σw·z,  S = Σw·z zᵀ     with z = (x, y) − c

where ``c`` is a fixed shift (the global means from a cheap first pass) so
the sums do not lose precision to cancellation.  Raw shifted sums are
additive: the training moments of fold f are ``total − fold f`` and need
no second scan.  Small problems use plain SQL aggregates (JVM codegen,
map-side partial aggregation); wide ones use ``mapInArrow`` with numpy
per partition and a ``groupBy(group, k)`` sum of the flattened triangle.
Only (groups × (p+1)²) numbers reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQL_MAX_TERMS = 500  # above this many product sums, use the Arrow path


@dataclass
class Moments:
    n: float
    shift: np.ndarray  # (q,) shift of (x..., y)
    s: np.ndarray  # (q,) Σw(z)
    S: np.ndarray  # (q, q) Σw z zᵀ

    @property
    def p(self) -> int:
        return len(self.shift) - 1

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.shift, self.s + other.s, self.S + other.S)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.n - other.n, self.shift, self.s - other.s, self.S - other.S)

    def means(self) -> np.ndarray:
        return self.shift + self.s / self.n

    def centered(self) -> np.ndarray:
        """Σw (z−mean)(z−mean)ᵀ, a (q, q) matrix."""
        d = self.s / self.n
        return self.S - self.n * np.outer(d, d)

    def uncentered(self) -> np.ndarray:
        """Σw z zᵀ about the origin (for models without an intercept)."""
        c = self.shift
        return self.S + np.outer(c, self.s) + np.outer(self.s, c) + self.n * np.outer(c, c)

    def parts(self, center: bool = True):
        """(XtX, Xty, yty, x_mean, y_mean) — centred unless ``center`` is False."""
        M = self.centered() if center else self.uncentered()
        mu = self.means()
        p = self.p
        return M[:p, :p], M[:p, p], M[p, p], mu[:p], mu[p]


def _weight(weight):
    if weight is None:
        return F.lit(1.0)
    return (F.col(weight) if isinstance(weight, str) else weight).cast("double")


def gram(
    df: DataFrame,
    features,
    target: str,
    weight=None,
    group: str | None = None,
    shift: np.ndarray | None = None,
) -> dict:
    """Moments per group value (key ``None`` when ungrouped)."""
    cols = list(features) + [target]
    q = len(cols)
    w = _weight(weight)
    if shift is None:
        r = df.agg(F.sum(w).alias("n"), *[F.sum(w * F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        n = r["n"] or 0.0
        shift = np.array([(r[f"m{i}"] / n) if n else 0.0 for i in range(q)])
    z = [(F.col(c).cast("double") - F.lit(float(shift[i]))) for i, c in enumerate(cols)]
    terms = q * (q + 1) // 2
    keys = [F.col(group)] if group else []
    out: dict = {}
    if terms <= SQL_MAX_TERMS:
        aggs = [F.sum(w).alias("n")] + [F.sum(w * z[i]).alias(f"s{i}") for i in range(q)]
        for i in range(q):
            for j in range(i, q):
                aggs.append(F.sum(w * z[i] * z[j]).alias(f"S{i}_{j}"))
        rows = df.groupBy(*keys).agg(*aggs).collect()
        for r in rows:
            S = np.zeros((q, q))
            for i in range(q):
                for j in range(i, q):
                    S[i, j] = S[j, i] = r[f"S{i}_{j}"]
            s = np.array([r[f"s{i}"] for i in range(q)], dtype=float)
            out[r[group] if group else None] = Moments(float(r["n"]), shift.copy(), s, S)
        return out
    return _gram_arrow(df, cols, weight, group, shift)


def gram_mapped(df: DataFrame, features, targets, fmap, out_dim: int, weight=None, group=None) -> dict:
    """Uncentred moments of ``[fmap(X), Y]`` where ``fmap`` is a picklable
    numpy feature map applied per Arrow batch on the executors (random
    hidden layers, kernel landmark features).  ``targets`` is one column
    name or a list (multi-output)."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    return _gram_arrow(
        df, list(features) + targets, weight, group, np.zeros(out_dim + len(targets)), fmap=fmap, n_targets=len(targets)
    )


def _gram_arrow(df, cols, weight, group, shift, fmap=None, n_targets: int = 1) -> dict:
    q_in = len(cols)
    q = len(shift)
    iu = np.triu_indices(q)
    sel = [F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(cols)]
    sel.append(_weight(weight).alias("w"))
    sel.append((F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("g"))
    shift_b = shift.astype(float)

    def partial(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            g = b.column("g").to_numpy(zero_copy_only=False)
            w = b.column("w").to_numpy(zero_copy_only=False)
            Z = np.column_stack([b.column(f"z{i}").to_numpy(zero_copy_only=False) for i in range(q_in)])
            if fmap is not None:
                Z = np.column_stack([fmap(Z[:, :-n_targets]), Z[:, -n_targets:]])
            Z = Z - shift_b
            for gv in np.unique(g):
                m = g == gv
                Zg, wg = Z[m], w[m]
                cross = (Zg.T * wg) @ Zg
                vec = np.concatenate([[wg.sum()], Zg.T @ wg, cross[iu]])
                acc[int(gv)] = acc.get(int(gv), 0) + vec
        if acc:
            gs, ks, vs = [], [], []
            for gv, vec in acc.items():
                gs.append(np.full(len(vec), gv, dtype=np.int64))
                ks.append(np.arange(len(vec), dtype=np.int64))
                vs.append(vec)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(gs)), pa.array(np.concatenate(ks)), pa.array(np.concatenate(vs))],
                names=["g", "k", "v"],
            )

    parts = df.select(*sel).mapInArrow(partial, "g long, k long, v double")
    rows = parts.groupBy("g", "k").agg(F.sum("v").alias("v")).collect()
    vals: dict[int, np.ndarray] = {}
    size = 1 + q + len(iu[0])
    for r in rows:
        vals.setdefault(r["g"], np.zeros(size))[r["k"]] = r["v"]
    out = {}
    for gv, vec in vals.items():
        S = np.zeros((q, q))
        S[iu] = vec[1 + q :]
        S = S + np.triu(S, 1).T
        out[gv if group else None] = Moments(float(vec[0]), shift.copy(), vec[1 : 1 + q].copy(), S)
    return out


def total(moments: dict) -> Moments:
    vals = list(moments.values())
    acc = vals[0]
    for m in vals[1:]:
        acc = acc + m
    return acc
