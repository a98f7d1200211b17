"""Error parity, bounds and equalities asked for after round 1."""

import numpy as np
import pandas as pd
import pytest

from regcast import select_lags, with_row_index
from regcast.functions import checks
from regcast.operators import elm, encoders, neighbors, trees
from regcast.operators.autocorr import pacf_from_acf
from regcast.plans import workflows as W
from regcast.plans.config import ModelSpec, PipelineConfig, TrainingConfig
from regcast.session import ensure_checkpoint_dir


def test_predict_refuses_a_null_target(spark, base):
    cfg = PipelineConfig(("feature",), "target", ("row",), None, ModelSpec("ridge"))
    fitted = W.train(base, TrainingConfig(cfg, "Random percent", 100)).artifact
    holed = base.selectExpr("row", "feature", "if(row = 3, null, target) as target")
    with pytest.raises(ValueError, match="The target contains missing values."):
        W.predict(fitted, holed)


def test_target_nulls_are_reported_before_feature_nulls(spark):
    df = spark.createDataFrame([(None, None), (2.0, 1.0)], "x double, y double")
    with pytest.raises(ValueError, match="The target contains missing values."):
        checks.validate_labeled_data(df, ("x",), "y")
    with pytest.raises(ValueError, match="Found nulls in: x"):
        checks.validate_labeled_data(df.selectExpr("x", "1.0D as y"), ("x",), "y")


@pytest.mark.parametrize(
    "rows,kind,text",
    [([("a",)], "string", "must be numeric"), ([(1.0,), (None,)], "double", "cannot contain missing"), ([], "double", "dataset is empty"), ([(float("nan"),)], "double", "only finite values")],
)
def test_series_errors(spark, rows, kind, text):
    with pytest.raises(ValueError, match=text):
        checks.validate_series(spark.createDataFrame(rows, f"v {kind}"), "v")


def test_every_lag_mode_refuses_a_series_that_is_not_finite(spark):
    ix = with_row_index(spark.createDataFrame([(i, float("nan") if i == 2 else float(i)) for i in range(6)], "t long, v double"), ["t"])
    for mode, more in (("All", {}), ("Manual", {"indices": (1,)}), ("Best N ACF", {"count": 1}), ("ACF threshold", {"threshold": 0.1})):
        with pytest.raises(ValueError, match="only finite numbers"):
            select_lags(ix, "v", 3, mode, **more)


def test_pacf_reflections_solve_their_definition():
    rng = np.random.default_rng(0)
    r = np.concatenate([[1.0], rng.uniform(-0.4, 0.4, 8)])
    got, a = pacf_from_acf(r), np.empty(0)
    for k in range(1, len(r)):  # numerator and denominator both pair the coefficients with the correlations in reverse
        u = sum(a[j] * r[k - 1 - j] for j in range(len(a)))
        assert got[k] == pytest.approx((r[k] - u) / (1 - u))
        a = np.array([*(a[j] - got[k] * a[len(a) - 1 - j] for j in range(len(a))), got[k]])


def test_one_hot_refuses_a_key_column(spark, monkeypatch):
    monkeypatch.setattr(encoders, "MAX_ONE_HOT", 3)
    df = spark.createDataFrame([(str(i),) for i in range(5)], "k string")
    with pytest.raises(ValueError, match="more than 3 columns for: k"):
        encoders.refuse_wide_one_hot(df, ["k"])


def test_a_tree_gets_its_exact_share_of_columns():
    for p, share in ((3, 0.3), (5, 0.5), (10, 0.25), (4, 1.0)):
        for t in range(30):
            assert len(trees._columns_of_tree(7000, t, p, share)) == max(1, int(np.ceil(share * p)))


def test_a_task_returns_one_partial_histogram(spark):
    """However many Arrow batches a task reads: cells are unique within it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = np.random.default_rng(1)
        df = spark.createDataFrame(pd.DataFrame({"b0": rng.integers(0, 4, 1000), "b1": rng.integers(0, 3, 1000), "_y": rng.normal(size=1000), "_rid": np.arange(1000)})).coalesce(1)
        df = df.selectExpr("cast(b0 as int) b0", "cast(b1 as int) b1", "_y", "_rid")
        grad = lambda b: (-b.column("_y").to_numpy(), np.ones(b.num_rows))
        rows = trees._SparkHistograms(df, 2, np.array([0, 4, 8]), grad).partials(trees.Tree(), [0]).collect()
        assert len(rows) == 7 and sum(r["C"] for r in rows) == 2000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_digamma_series():
    n = np.array([1, 2, 10, 64, 65, 1000, 10**9])
    exact = [sum(1.0 / k for k in range(1, m)) - neighbors.EULER for m in n[:-1]]
    assert np.allclose(neighbors._digamma_int(n)[:-1], exact, rtol=0, atol=1e-12)
    assert neighbors._digamma_int(n)[-1] == pytest.approx(np.log(1e9) - 0.5e-9)


def test_mrmr_ranking_by_hand():
    relevance, redundancy = np.array([3.0, 2.9, 1.0]), np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0.0]])
    assert neighbors._mrmr_ranking(relevance, redundancy, "difference").tolist() == [3.0, 2.0, 1.0]
    assert neighbors._mrmr_ranking(np.array([3.0, 1.5, 1.0]), redundancy, "difference").tolist() == [3.0, 1.0, 2.0]


def test_elm_with_two_targets_equals_two_models(spark):
    x = np.linspace(-1, 1, 40)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y1": x**2, "y2": x**3}))
    both = elm.elm_fit(df, ["x"], ["y1", "y2"], alpha=1e-3)
    assert both.beta.shape == (100, 2)
    for i, t in enumerate(("y1", "y2")):
        assert np.allclose(both.predict_numpy(x[:, None])[:, i], elm.elm_fit(df, ["x"], t).predict_numpy(x[:, None]), atol=1e-8)
    row = both.transform(df).first()
    assert len(row["prediction"]) == 2


def test_elm_classifier_keeps_the_label_type_and_gives_probabilities(spark):
    df = spark.createDataFrame([(-2.0, 7), (-1.5, 7), (1.5, 11), (2.0, 11)], "a double, label int")
    out = elm.elm_classifier_fit(df, ["a"], "label", n_hidden=30, alpha=1e-6).transform(df)
    assert dict(out.dtypes)["prediction"] == "int"
    for r in out.collect():
        assert r["prediction"] == r["label"] and sum(r["prediction_proba"]) == pytest.approx(1.0)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
