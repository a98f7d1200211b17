import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regcast.operators import autocorr
from regcast.operators.lags import lookback_features, with_lags, windows
from regcast.operators.rowindex import with_row_index


def series(spark, values):
    pdf = pd.DataFrame({"t": np.arange(len(values)), "value": np.asarray(values, dtype=float)})
    return with_row_index(spark.createDataFrame(pdf), ["t"])


def np_acf(v, k):
    c = v - v.mean()
    d = c @ c
    return np.array([1.0] + [c[:-j] @ c[j:] / d for j in range(1, k + 1)])


def test_halo_lags_equal_a_global_window(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=500)
    ix = series(spark, v)
    got = with_lags(ix.df, "value", [1, 3, 7], names=["l1", "l3", "l7"], block=16).orderBy("idx").toPandas()
    for k in (1, 3, 7):
        ref = np.concatenate([[np.nan] * k, v[:-k]])
        assert np.allclose(got[f"l{k}"].to_numpy(dtype=float), ref, equal_nan=True)


def test_acf_and_pacf_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.cumsum(rng.normal(size=300)) * 0.1 + rng.normal(size=300)
    ix = series(spark, v)
    r = autocorr.acf_values(ix, "value", 12)
    assert np.allclose(r, np_acf(v, 12))
    p = autocorr.pacf_from_acf(r)
    # lag 1 and 2 have the closed forms
    assert p[1] == pytest.approx(r[1]) and p[2] == pytest.approx((r[2] - r[1] ** 2) / (1 - r[1] ** 2))


def test_acf_errors(spark):
    with pytest.raises(ValueError, match="constant"):
        autocorr.acf_values(series(spark, [1.0, 1.0, 1.0]), "value")
    with pytest.raises(ValueError, match="smaller"):
        autocorr.acf_values(series(spark, [1.0, 2.0, 3.0]), "value", 3)


def test_lag_selection_modes(spark):
    ix = series(spark, [1, 2, 4, 3, 5, 7, 6, 8])
    assert autocorr.select_lags(ix, "value", 4, "All") == (1, 2, 3, 4)
    assert autocorr.select_lags(ix, "value", 4, "Manual", indices=(4, 2, 2)) == (2, 4)
    mags = np.abs(np_acf(np.array([1, 2, 4, 3, 5, 7, 6, 8.0]), 4)[1:])
    best = tuple(sorted(int(i) + 1 for i in np.argsort(-mags, kind="stable")[:2]))
    assert autocorr.select_lags(ix, "value", 4, "Best N ACF", count=2) == best
    assert autocorr.select_lags(ix, "value", 4, "ACF threshold", threshold=0.0) == (1, 2, 3, 4)
    with pytest.raises(ValueError, match="No lags"):
        autocorr.select_lags(ix, "value", 4, "ACF threshold", threshold=1.0)


def test_sparse_windows_count_and_order(spark):
    ix = series(spark, np.arange(12.0))
    w = windows(ix.df, "value", (1, 3, 5)).orderBy("idx").toPandas()
    assert len(w) == 7
    assert list(w.iloc[0]["window"]) == [0.0, 2.0, 4.0] and w.iloc[0]["label"] == 5.0


def test_lookback_features_drop_first_rows(spark):
    ix = series(spark, [10.0, 20, 30, 40, 50, 60])
    out = lookback_features(ix.df, "value", 3).orderBy("idx").toPandas()
    assert len(out) == 3
    assert list(out.iloc[0][["value_lag_1", "value_lag_2", "value_lag_3"]]) == [30.0, 20.0, 10.0]


def test_correlation_table_bounds(spark):
    t = autocorr.correlation_table(spark, np.array([1.0, 0.5]), 100).collect()
    assert t[0]["bound"] == pytest.approx(0.196) and t[1]["zero"] == 0.0
