"""Voting regressor: the plain mean of the member regressors.

Each member is fitted as its own Spark jobs (its defaults, overridden by
nested ``<key>__<param>`` parameters); prediction adds the members'
prediction columns and divides — one projection for expression-scored
members, Arrow UDFs for the others — over the distinct rows of features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KIND_CELLS = 1_000_000  # numbers of the scored kinds of rows that a join may broadcast

# The members whose fits are the longest chains of jobs start first.
LONGEST = ("gaussian_process", "svm", "nu_svr", "huber_regressor", "catboost", "hist_gradient_boosting", "quantile_regressor", "random_forest", "adaboost", "mlp")


def _keeps_rows(model) -> bool:
    """Whether the model scores by jobs of its own over a table (neighbours, subtrees) and not by a projection."""
    return any(isinstance(v, DataFrame) for v in vars(model).values())


@dataclass
class VotingModel:
    features: list
    members: list  # (key, model)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if df.isStreaming:
            return self._score(df, output)
        # rows with equal features have one prediction: scored once, then joined back
        names = list(self.features)
        session = df.sparkSession
        kinds = df.select(*names).distinct().repartition(session.sparkContext.defaultParallelism, *names)
        scored = materialize(self._score(kinds, output).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], output))
        if scored.count() * (len(names) + 1) <= KIND_CELLS:
            scored = F.broadcast(scored)
        same = F.lit(True)
        for i, c in enumerate(names):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        return df.join(scored, same).drop(*[f"_k{i}" for i in range(len(names))])

    def _score(self, df: DataFrame, output: str) -> DataFrame:
        out = df
        # a member that keeps a table of rows goes first: its jobs then do not score the others' columns
        order = sorted(range(len(self.members)), key=lambda i: not _keeps_rows(self.members[i][1]))
        for i in order:
            out = self.members[i][1].transform(out, f"_v{i}")
        cols = [F.col(f"_v{i}") for i in range(len(self.members))]
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        return out.withColumn(output, total / F.lit(float(len(cols)))).drop(*[f"_v{i}" for i in range(len(cols))])

    def predict_numpy(self, X: np.ndarray) -> np.ndarray:
        return np.mean([m.predict_numpy(X) for _k, m in self.members], axis=0)

    def to_dict(self):
        return {
            "kind": "voting",
            "class": "regcast.operators.voting.VotingModel",
            "features": self.features,
            "members": [[k, m.to_dict()] for k, m in self.members],
        }

    @classmethod
    def from_dict(cls, d):
        from .models import model_from_dict

        return cls(d["features"], [(k, model_from_dict(m)) for k, m in d["members"]])


def voting_fit(df: DataFrame, features, target: str, estimators=None, **params):
    from .models import VOTING_MEMBERS, fit_model

    keys = list(estimators) if estimators else list(VOTING_MEMBERS)
    unknown = [k for k in keys if k not in VOTING_MEMBERS]
    if unknown:
        raise ValueError("Unknown voting members: " + ", ".join(unknown))
    nested: dict[str, dict] = {}
    for name, value in params.items():
        key, sep, param = name.partition("__")
        if not sep or key not in VOTING_MEMBERS:
            raise ValueError(f"Unknown voting parameter: {name}")
        nested.setdefault(key, {})[param] = value
    from ..plans.parallel import MAX_WORKERS, run_all

    # most fits are chains of small jobs: as many at a time as there are cores
    workers = max(MAX_WORKERS, df.sparkSession.sparkContext.defaultParallelism)
    first = sorted(keys, key=lambda k: LONGEST.index(k) if k in LONGEST else len(LONGEST))
    data = df.persist()
    try:
        fits = run_all([lambda k=k: fit_model(k, data, features, target, nested.get(k, {})) for k in first], workers)
    finally:
        data.unpersist()
    found = dict(zip(first, fits))
    return VotingModel(list(features), [(k, found[k]) for k in keys])
