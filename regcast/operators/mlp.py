"""Multi-layer perceptron regressor (``mlp``) — L1 on Spark.

Objective (as the reference's regressor): ½·mean squared error +
α/(2n)·Σ‖W‖², weights initialised Glorot-uniform from a NumPy
``RandomState(42)`` (layer by layer: weights, then biases).  Training is
full-batch L-BFGS whose loss and gradient are summed over the rows by
Arrow tasks (NumPy forward/backward per batch) — one Spark job per
iteration, ``max_iter`` iterations.  Up to ``TASK_WORK`` rows × parameters a
job takes longer to start than to run: there one task makes all iterations.  The reference's optimiser is
mini-batch Adam with its own shuffling; we minimise the same objective
deterministically instead.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowopt import arrow_objective
from .optim import lbfgs
from .trees import MERGE_ROWS, SUBTREE_CELLS, _merged, _rows

TASK_WORK = 40_000_000  # rows x parameters of a fit that one task makes
ACTS = ("identity", "logistic", "tanh", "relu")


def _act(z, kind):
    if kind == "relu":
        return np.maximum(z, 0.0)
    if kind == "tanh":
        return np.tanh(z)
    if kind == "logistic":
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    return z


def _dact(a, kind):
    """Derivative expressed through the activation output ``a``."""
    if kind == "relu":
        return (a > 0).astype(float)
    if kind == "tanh":
        return 1.0 - a * a
    if kind == "logistic":
        return a * (1.0 - a)
    return np.ones_like(a)


def parse_layers(spec) -> tuple[int, ...]:
    if isinstance(spec, (list, tuple)):
        return tuple(int(v) for v in spec)
    return tuple(int(v.strip()) for v in str(spec).split(",") if v.strip())


@dataclass
class Net:
    sizes: tuple  # (p, h1, ..., 1)
    activation: str
    output: str = "identity"

    def shapes(self):
        return [(a, b) for a, b in zip(self.sizes[:-1], self.sizes[1:])]

    def n_params(self):
        return sum(a * b + b for a, b in self.shapes())

    def unpack(self, th):
        out, i = [], 0
        for a, b in self.shapes():
            W = th[i : i + a * b].reshape(a, b)
            i += a * b
            c = th[i : i + b]
            i += b
            out.append((W, c))
        return out

    def init(self, seed: int = 42) -> np.ndarray:
        rng = np.random.RandomState(seed)
        parts = []
        for a, b in self.shapes():
            factor = 2.0 if self.activation == "logistic" else 6.0
            bound = np.sqrt(factor / (a + b))
            parts.append(rng.uniform(-bound, bound, (a, b)).ravel())
            parts.append(rng.uniform(-bound, bound, b))
        return np.concatenate(parts)

    def forward(self, X, th):
        acts = [X]
        layers = self.unpack(th)
        for li, (W, c) in enumerate(layers):
            z = acts[-1] @ W + c
            kind = self.output if li == len(layers) - 1 else self.activation
            acts.append(_act(z, kind))
        return acts

    def loss_grad(self, X, y, th, w=None):
        """Σ ½(ŷ−y)² and its gradient over a batch; ``w`` tells how many rows each stands for."""
        layers = self.unpack(th)
        acts = self.forward(X, th)
        out = acts[-1][:, 0]
        err = out - y
        weighed = err if w is None else w * err
        loss = 0.5 * float(weighed @ err)
        delta = (weighed * _dact(acts[-1][:, 0], self.output))[:, None]
        grads = []
        for li in range(len(layers) - 1, -1, -1):
            W, _c = layers[li]
            grads.append((acts[li].T @ delta, delta.sum(0)))
            if li > 0:
                delta = (delta @ W.T) * _dact(acts[li], self.activation)
        grads.reverse()
        return loss, np.concatenate([np.concatenate([gW.ravel(), gc]) for gW, gc in grads])


@dataclass
class MLPModel:
    features: list
    net: Net
    theta: np.ndarray

    def predict_numpy(self, X):
        return self.net.forward(np.asarray(X, dtype=float), self.theta)[-1][:, 0]

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        model = self
        feats = list(self.features)

        @F.pandas_udf("double")
        def score(cols: pd.DataFrame) -> pd.Series:
            return pd.Series(model.predict_numpy(cols[feats].to_numpy(dtype=float)))

        return df.withColumn(output, score(F.struct(*[F.col(c).cast("double").alias(c) for c in feats])))

    def to_dict(self):
        return {"kind": "mlp", "class": "regcast.operators.mlp.MLPModel", "features": self.features,
                "sizes": list(self.net.sizes), "activation": self.net.activation, "output": self.net.output,
                "theta": self.theta.tolist()}

    @classmethod
    def from_dict(cls, d):
        return cls(d["features"], Net(tuple(d["sizes"]), d["activation"], d.get("output", "identity")), np.array(d["theta"]))

    def to_json(self):
        return json.dumps(self.to_dict())


def train_net(df: DataFrame, x_cols, y_col: str, net: Net, alpha: float, max_iter: int, seed: int = 42) -> np.ndarray:
    n, p = df.count(), len(x_cols)
    weight, within = None, 0.0
    if n >= MERGE_ROWS or n * (p + 4) > SUBTREE_CELLS:  # equal rows of features: their number, mean target and the constant around it
        names = [f"x{j}" for j in range(p)]
        merged = _merged(_rows(df, x_cols, y_col, binned=False)[0], names, n)
        if merged:
            df, x_cols, y_col, weight = merged[0], names, "_y", "_many"
            within = 0.5 * float(df.agg(F.sum("_ss")).first()[0])
    held = merged[1] if weight else n
    weight_mask = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in net.shapes()])

    def regular(base):
        def fun(th):
            f, g = base(th)
            wpart = th * weight_mask
            return (f + within) / n + 0.5 * alpha * float(wpart @ wpart) / n, g / n + alpha * wpart / n

        return fun

    objective = arrow_objective(df, x_cols, y_col, net.loss_grad, weight)

    def train(base):
        return lbfgs(regular(base), net.init(seed), max_iter=max_iter, tol=1e-10)

    return objective.in_task(train) if held * net.n_params() <= TASK_WORK else train(objective)


def mlp_fit(df, features, target, hidden_layer_sizes="100", activation="relu", alpha=1e-4, max_iter=200, **_):
    if activation not in ACTS:
        raise ValueError(f"Unsupported activation: {activation}")
    layers = parse_layers(hidden_layer_sizes)
    net = Net((len(features), *layers, 1), activation)
    th = train_net(df, features, target, net, float(alpha), int(max_iter))
    return MLPModel(list(features), net, th)
