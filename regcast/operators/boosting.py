"""AdaBoost.R2 (``adaboost``) on exact trees.

Each round fits a depth-3 tree to the current sample weights (weights
enter the sums — reweighting, where the reference resamples), measures the
largest error and the weighted losses in one pass, and multiplies each row's
weight by a factor that follows from the tree alone; the factors are folded
into a checkpointed column every ``REFRESH`` rounds. Prediction is the
weighted median of the rounds' predictions (estimator weights ln(1/β)).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .trees import REFRESH, GrowSpec, RowKinds, Tree, _col, _grow_exact_trees, _matrix, _merged, _ones, _rows, _walk


@dataclass
class AdaBoostModel:
    features: list
    trees: list
    estimator_weights: list

    def predict_numpy(self, X: np.ndarray) -> np.ndarray:
        X = np.asarray(X, dtype=float)
        preds = np.column_stack([t.value[_walk(t, X, on_bins=False)] for t in self.trees])
        order = np.argsort(preds, axis=1, kind="stable")
        w = np.asarray(self.estimator_weights)[order]
        cdf = np.cumsum(w, axis=1)
        pick = (cdf >= 0.5 * cdf[:, -1:]).argmax(axis=1)
        return preds[np.arange(X.shape[0]), order[np.arange(X.shape[0]), pick]]

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        model = self
        feats = list(self.features)

        @F.pandas_udf("double")
        def score(cols: pd.DataFrame) -> pd.Series:
            return pd.Series(model.predict_numpy(cols[feats].to_numpy(dtype=float)))

        return df.withColumn(output, score(F.struct(*[F.col(c).cast("double").alias(c) for c in feats])))

    def to_dict(self):
        return {"kind": "adaboost", "class": "regcast.operators.boosting.AdaBoostModel", "features": self.features,
                "trees": [t.to_dict() for t in self.trees], "estimator_weights": list(self.estimator_weights)}

    @classmethod
    def from_dict(cls, d):
        return cls(d["features"], [Tree.from_dict(t) for t in d["trees"]], d["estimator_weights"])


def adaboost_fit(df, features, target, n_estimators=50, learning_rate=1.0, loss="linear", max_depth=3, **_):
    """Weights are a factor per round on the start weight 1: the column ``_w``
    holds those up to the last checkpoint, newer rounds are applied on the fly.
    Only ratios of weights matter, so they are never normalised."""
    if loss not in ("linear", "square", "exponential"):
        raise ValueError("loss must be linear, square or exponential")
    rows, _, n = _rows(df, features, target, binned=False)
    p = len(features)
    merged = _merged(rows, [f"x{j}" for j in range(p)], n)
    kinds = RowKinds(rows, merged[0], p) if merged else None
    data = (kinds.data if kinds else rows).withColumn("_w", F.lit(1.0))
    spec = GrowSpec(max_depth=max_depth)
    trees, weights = [], []
    pending: list[tuple] = []  # (prediction, largest error, beta) of rounds not folded into _w yet

    def share(error, largest):
        e = error / largest
        return e if loss == "linear" else e * e if loss == "square" else 1.0 - np.exp(-e)

    def told(tree):
        """What predicts a batch's rows: the tree, or its values for the kinds of rows."""
        values = tree.value[_walk(tree, kinds.X, on_bins=False)] if kinds else None
        return (lambda b: values[b.column("_kind").to_numpy(zero_copy_only=False)]) if kinds else lambda b: tree.value[_walk(tree, _matrix(b, p), on_bins=False)]

    def weight_of(b, rounds):
        y, w = _col(b, "_y"), _col(b, "_w")
        for predict, largest, beta in rounds:
            w = w * beta ** ((1.0 - share(np.abs(predict(b) - y), largest)) * learning_rate)
        return y, w

    def measure(predict, rounds, largest):
        """Largest error, and sums of weights, errors and losses (with ``largest`` given) over all rows."""

        def run(batches):
            top, sums = 0.0, np.zeros(4)
            for b in batches:
                y, w = weight_of(b, rounds)
                e = np.abs(predict(b) - y)
                top = max(top, float(e.max(initial=0.0)))
                sums += [w.sum(), w @ e, w @ (e * e), w @ share(e, largest) if largest else 0.0]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (top, *sums)], names=["top", "w", "e", "q", "l"])

        out = data.mapInArrow(run, "top double, w double, e double, q double, l double").agg(F.max("top"), *[F.sum(c) for c in "weql"]).first()
        return [float(v) for v in out]

    for k in range(int(n_estimators)):

        def weighted(b, rounds=tuple(pending)):
            return weight_of(b, rounds)

        if kinds:
            kinds.data = data
            grown = kinds.grow([0], lambda b, t, weighted=weighted: (weighted(b)[1], np.ones(b.num_rows)), spec, k).first()
            tree = Tree.unpack(grown["n"], grown["blob"])
        else:
            tree = _grow_exact_trees(data, p, n, 1, spec, weighted, _ones, seed=k)[0][0]
        predict = told(tree)
        largest, total, linear, squared, _ = measure(predict, tuple(pending), 0.0)
        if largest == 0:
            trees.append(tree)
            weights.append(1.0)
            break
        lost = {"linear": linear / largest, "square": squared / largest**2}.get(loss)
        est_err = (measure(predict, tuple(pending), largest)[4] if lost is None else lost) / total
        if est_err >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = est_err / (1.0 - est_err)
        trees.append(tree)
        weights.append(float(learning_rate * np.log(1.0 / beta)) if beta > 0 else 1.0)
        if beta <= 0:
            break
        pending.append((predict, largest, beta))
        if len(pending) >= REFRESH:

            def fold(batches, rounds=tuple(pending)):
                for b in batches:
                    w = weight_of(b, rounds)[1]
                    yield pa.RecordBatch.from_arrays([b.column(c) if c != "_w" else pa.array(w) for c in b.schema.names], names=b.schema.names)

            data, pending = materialize(data.mapInArrow(fold, data.schema)), []
    return AdaBoostModel(list(features), trees, weights)
