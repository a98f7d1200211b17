"""Tables beyond a task whose distinct rows fit one: the models of the whole table, without jobs per round."""

import numpy as np
import pandas as pd
import pytest

from regcast.operators import trees as TR
from regcast.operators.models import fit_model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 3000
    pdf = pd.DataFrame({"idx": np.arange(n), "a": rng.integers(0, 9, n).astype(float), "b": rng.integers(0, 5, n).astype(float), "c": rng.integers(0, 2, n).astype(float)})
    pdf["y"] = pdf.a**2 - 3 * pdf.b * pdf.c + rng.normal(size=n)
    return spark.createDataFrame(pdf).repartition(6).cache(), pdf[["a", "b", "c"]].to_numpy()


MODELS = [
    ("decision_tree", {}), ("extra_trees", {"n_estimators": 4}), ("random_forest", {"n_estimators": 4}), ("bagging", {}),
    ("gradient_boosting", {"n_estimators": 12}), ("hist_gradient_boosting", {"max_iter": 12, "early_stopping": True}),
    ("xgboost", {"n_estimators": 12}), ("lightgbm", {"n_estimators": 12}), ("catboost", {"iterations": 12}),
    ("adaboost", {"n_estimators": 12}), ("adaboost", {"n_estimators": 4, "loss": "exponential"}),
]


@pytest.mark.parametrize("key,params", MODELS)
def test_merged_rows_give_the_model_of_all_rows(table, monkeypatch, key, params):
    df, X = table
    want = fit_model(key, df, ["a", "b", "c"], "y", params).predict_numpy(X)
    monkeypatch.setattr(TR, "SUBTREE_CELLS", 90 * 7)

    def refuse(*_, **__):
        raise AssertionError("a job over the whole table for each step")

    monkeypatch.setattr(TR._TopPhase, "splits", refuse)
    monkeypatch.setattr(TR, "_hist_tree", refuse)
    got = fit_model(key, df, ["a", "b", "c"], "y", params).predict_numpy(X)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_many_distinct_rows_are_not_merged(table, monkeypatch):
    df, _ = table
    rows = TR._rows(df, ["a", "b", "c"], "y", False)[0]
    assert TR._merged(rows, ["x0", "x1", "x2"], 3000) is None  # fits a task
    monkeypatch.setattr(TR, "SUBTREE_CELLS", 80 * 7)
    assert TR._merged(rows, ["x0", "x1", "x2"], 3000) is None  # 90 kinds do not


@pytest.mark.parametrize("rank", [4096, 20])
def test_kernel_ridge_on_merged_rows(table, monkeypatch, rank):
    from regcast.operators import kernel_exact as KX

    df, X = table
    monkeypatch.setattr(KX, "MAX_RANK", rank)  # 20 pivots are too few: conjugate gradients
    y = np.array([r[0] for r in df.orderBy("idx").select("y").collect()])
    K = np.exp(-0.3 * ((X[:, None] - X[None]) ** 2).sum(axis=-1))
    want = K @ np.linalg.solve(K + 0.5 * np.eye(len(X)), y)
    monkeypatch.setattr(TR, "SUBTREE_CELLS", 90 * 7)
    seen = []
    plain = KX._draw_rows
    monkeypatch.setattr(KX, "_draw_rows", lambda data, *a: seen.append(data.count()) or plain(data, *a))
    model = fit_model("kernel_ridge", df, ["a", "b", "c"], "y", {"kernel": "rbf", "gamma": 0.3, "alpha": 0.5})
    assert max(seen) == 90
    assert np.allclose(model.predict_numpy(X), want, atol=1e-6)


def test_mlp_on_merged_rows(table, monkeypatch):
    from regcast.operators import mlp as ML

    df, X = table
    params = {"hidden_layer_sizes": "4", "max_iter": 8, "activation": "tanh"}
    want = fit_model("mlp", df, ["a", "b", "c"], "y", params).predict_numpy(X)
    seen = []
    plain = ML.arrow_objective
    monkeypatch.setattr(ML, "arrow_objective", lambda data, *a: seen.append(data.count()) or plain(data, *a))
    monkeypatch.setattr(TR, "SUBTREE_CELLS", 90 * 7)
    monkeypatch.setattr(ML, "SUBTREE_CELLS", 90 * 7)
    got = fit_model("mlp", df, ["a", "b", "c"], "y", params).predict_numpy(X)
    assert seen == [90]
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
