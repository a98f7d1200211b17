"""Support vector regression on the pivots of the kernel: the dual's solution, without a job per working set."""

import warnings

import numpy as np
import pandas as pd
import pytest

from regcast.operators import kernel_exact as KE
from regcast.operators import kernel_newton as KN
from regcast.operators import kernels as K


def table(n=500, seed=3, kinds=60, hot=0.4):
    """Rows of few kinds, one of them hot, with a target of their own each."""
    rng = np.random.default_rng(seed)
    X = rng.uniform(-2, 2, (kinds, 2))[rng.integers(0, kinds, n)]
    X[: int(hot * n)] = X[0]
    return X, np.sin(2 * X[:, 0]) + X[:, 0] * X[:, 1] + rng.standard_t(3, n) * 0.3


def frame(spark, X, y, parts=3):
    return spark.createDataFrame(pd.DataFrame({**{f"f{j}": X[:, j] for j in range(X.shape[1])}, "y": y, "idx": np.arange(len(y))})).repartition(parts)


@pytest.fixture
def whole(monkeypatch):
    """The solution by working sets, and then the same fit with none allowed."""

    def compare(fit, X, **kw):
        monkeypatch.setattr(KE, "DIRECT_ROWS", 10**9)
        want = fit(**kw)
        monkeypatch.setattr(KE, "DIRECT_ROWS", 10)

        def refuse(*_):
            raise AssertionError("a job per working set")

        with monkeypatch.context() as m, warnings.catch_warnings():
            m.setattr(KE, "KernelRows", refuse)
            warnings.simplefilter("error")
            got = fit(**kw)
        assert got.extra["violation"] <= 1e-3 and abs(got.extra["gap"]) < 1e-3
        assert abs(got.extra["epsilon"] - want.extra["epsilon"]) < 2e-3
        assert np.abs(got.predict_numpy(X) - want.predict_numpy(X)).max() < 4e-3
        return got

    return compare


@pytest.mark.parametrize("kw", [
    {"C": 1.0, "gamma": 0.5}, {"C": 0.01, "gamma": 0.5}, {"C": 20.0, "gamma": 0.3, "epsilon": 0.5}, {"C": 1.0, "epsilon": 0.0, "gamma": "scale"},
    {"kernel": "linear"}, {"kernel": "poly", "degree": 2, "gamma": 0.5, "coef0": 1.0},
])
def test_svr_is_that_of_the_working_sets(spark, whole, kw):
    X, y = table()
    df = frame(spark, X, y)
    whole(lambda **kw: K.svr_fit(df, ["f0", "f1"], "y", **kw), X, **kw)


@pytest.mark.parametrize("kw", [{"nu": 0.5, "gamma": 0.5}, {"nu": 0.1, "C": 5.0, "gamma": 0.3}, {"nu": 0.9, "C": 0.1}])
def test_nu_svr_is_that_of_the_working_sets(spark, whole, kw):
    X, y = table(seed=4)
    df = frame(spark, X, y)
    m = whole(lambda **kw: K.nu_svr_fit(df, ["f0", "f1"], "y", **kw), X, **kw)
    r = np.abs(y - m.predict_numpy(X))
    assert (r > m.extra["epsilon"] + 2e-3).mean() <= kw["nu"] + 1e-9 and (r >= m.extra["epsilon"] - 2e-3).mean() >= kw["nu"] - 1e-9


@pytest.mark.parametrize("fit", [K.svr_fit, K.nu_svr_fit])
def test_narrow_bands_and_added_stripes(spark, whole, monkeypatch, fit):
    """Few rows on the driver, and sums added by Spark."""
    monkeypatch.setattr(KN, "BAND", 24)
    monkeypatch.setattr(KN, "COLLECTED", 4)
    monkeypatch.setattr(KN, "STRIPE", 8)
    X, y = table(n=400, seed=5)
    df = frame(spark, X, y)
    whole(lambda **kw: fit(df, ["f0", "f1"], "y", **kw), X, gamma=0.5)


def test_many_copies_of_a_row_weigh_their_number(spark, monkeypatch):
    monkeypatch.setattr(KE, "DIRECT_ROWS", 10)
    X, y = table(n=120, seed=6)
    one = K.svr_fit(frame(spark, X, y), ["f0", "f1"], "y", gamma=0.5, C=1.0)
    more = K.svr_fit(frame(spark, np.tile(X, (10, 1)), np.tile(y, 10)), ["f0", "f1"], "y", gamma=0.5, C=0.1)
    assert np.abs(one.predict_numpy(X) - more.predict_numpy(X)).max() < 2e-3


def test_rows_beyond_a_broadcast_are_solved(spark, monkeypatch):
    """Refused before: the rows were all on the driver."""
    monkeypatch.setattr(KE, "DIRECT_ROWS", 10)
    monkeypatch.setattr(KE, "MAX_CELLS", 100)
    X, y = table(n=300)
    m = K.svr_fit(frame(spark, X, y), ["f0", "f1"], "y", gamma=0.5)
    assert m.extra["violation"] <= 1e-3


def test_a_kernel_that_pivots_do_not_span_keeps_the_working_sets(spark, monkeypatch):
    X, y = table(n=200)
    want = K.svr_fit(frame(spark, X, y), ["f0", "f1"], "y", gamma=0.5)
    monkeypatch.setattr(KE, "DIRECT_ROWS", 10)
    monkeypatch.setattr(KE, "MAX_RANK", 5)
    got = K.svr_fit(frame(spark, X, y), ["f0", "f1"], "y", gamma=0.5)
    assert "rank" not in got.extra and np.allclose(got.predict_numpy(X), want.predict_numpy(X))
    same = K.svr_fit(frame(spark, X, np.full(200, 2.0)), ["f0", "f1"], "y", gamma=0.5)
    assert np.allclose(same.predict_numpy(X), 2.0, atol=0.11)
