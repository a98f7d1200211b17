"""The voting regressor's members without a job per round, and its prediction over the kinds of rows."""

import warnings

import numpy as np
import pandas as pd
import pytest

from regcast.operators import mlp as ML
from regcast.operators import trees as TR
from regcast.operators.models import fit_model
from regcast.operators.voting import VotingModel

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    n = 1500
    pdf = pd.DataFrame({"idx": np.arange(n), "a": rng.integers(0, 9, n).astype(float), "b": rng.integers(0, 5, n).astype(float), "c": rng.integers(0, 2, n).astype(float)})
    pdf["y"] = pdf.a**2 - 3 * pdf.b * pdf.c + rng.normal(size=n)
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf[NAMES].to_numpy()


@pytest.mark.parametrize("key,params", [("catboost", {"iterations": 25}), ("gradient_boosting", {"n_estimators": 25})])
def test_boosting_of_a_table_that_fits_a_task_is_one_job(table, monkeypatch, key, params):
    df, X = table
    monkeypatch.setattr(TR, "TASK_ROUNDS", TR.REFRESH)
    want = fit_model(key, df, NAMES, "y", params).predict_numpy(X)
    monkeypatch.setattr(TR, "TASK_ROUNDS", 100)
    calls, plain = [], TR._rounds_in_task
    monkeypatch.setattr(TR, "_rounds_in_task", lambda *a: calls.append(len(a[5])) or plain(*a))
    got = fit_model(key, df, NAMES, "y", params).predict_numpy(X)
    assert calls == [25]
    assert np.array_equal(got, want)


@pytest.mark.parametrize("key,params", [("catboost", {"iterations": 12}), ("random_forest", {"n_estimators": 3}), ("hist_gradient_boosting", {"max_iter": 8, "early_stopping": True})])
def test_equal_rows_are_merged_in_a_table_that_fits_a_task(table, monkeypatch, key, params):
    df, X = table
    want = fit_model(key, df, NAMES, "y", params).predict_numpy(X)
    seen, plain = [], TR._merged
    monkeypatch.setattr(TR, "_merged", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(TR, "MERGE_ROWS", 1000)
    got = fit_model(key, df, NAMES, "y", params).predict_numpy(X)
    assert seen[0] is not None and seen[0][1] <= 90
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_rows_that_are_seldom_equal_are_not_merged(table, monkeypatch):
    df, _ = table
    monkeypatch.setattr(TR, "MERGE_ROWS", 1000)
    rows = TR._rows(df, ["a", "y"], "y", False)[0]
    assert TR._merged(rows, ["x0", "x1"], 1500) is None


def test_mlp_in_one_task(table, monkeypatch):
    df, X = table
    params = {"hidden_layer_sizes": "4", "max_iter": 8, "activation": "tanh"}
    with pytest.warns(UserWarning, match="8 iterations"):
        got = fit_model("mlp", df, NAMES, "y", params).predict_numpy(X)
    monkeypatch.setattr(ML, "TASK_WORK", 0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = fit_model("mlp", df, NAMES, "y", params).predict_numpy(X)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6)


def test_voting_scores_equal_rows_once(spark, table):
    df, _ = table
    members = ["linear_regression", "decision_tree", "knn"]
    params = {"decision_tree__max_depth": 3}
    m = fit_model("voting_regressor", df, NAMES, "y", {"estimators": members, **params})
    assert [k for k, _ in m.members] == members
    rows = [(i, float(i % 3), 1.0, float(i % 2), f"t{i}") for i in range(60)]
    some = spark.createDataFrame(rows, "row long, a double, b double, c double, tag string").repartition(3)
    seen, plain = [], VotingModel._score
    try:
        VotingModel._score = lambda self, d, o: seen.append(d.count()) or plain(self, d, o)
        got = m.transform(some, "p").orderBy("row").collect()
    finally:
        VotingModel._score = plain
    assert seen == [6]
    assert [r["tag"] for r in got] == [x[4] for x in rows]
    parts = [{r["row"]: r["p"] for r in one.transform(some, "p").collect()} for _, one in m.members]
    assert np.allclose([r["p"] for r in got], [sum(p[i] for p in parts) / 3 for i in range(60)], rtol=1e-12)


def test_voting_keeps_rows_with_null_features(spark, table):
    df, _ = table
    m = fit_model("voting_regressor", df, NAMES, "y", {"estimators": ["linear_regression", "ridge"]})
    some = spark.createDataFrame([(0, None, 1.0, 0.0), (1, None, 1.0, 0.0), (2, 2.0, 1.0, 0.0)], "row long, a double, b double, c double")
    got = [r["p"] for r in m.transform(some, "p").orderBy("row").collect()]
    assert got[:2] == [None, None] and got[2] is not None
