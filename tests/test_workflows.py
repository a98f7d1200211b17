"""End-to-end workflows, ported from the reference's behavioural tests."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regcast.functions.profile import preprocessing_plan
from regcast.plans import workflows as W
from regcast.plans.config import FeatureSelection, ModelSpec, PipelineConfig, TrainingConfig, ValidationConfig
from regcast.sources.artifacts import deserialize_artifact, serialize_artifact

RF = ModelSpec("random_forest", {"n_estimators": 10, "max_depth": None, "min_samples_split": 2})


def cfg(df, features=("feature",), model=RF, **kw):
    return PipelineConfig(tuple(features), "target", ("row",), preprocessing_plan(df, list(features)), model, **kw)


def test_training_returns_artifact_and_test_predictions(base):
    test = base.where(F.col("row") >= 16)
    res = W.train(base, TrainingConfig(cfg(base), "Last percent", 50), test)
    assert res.trained_rows == 10
    assert res.prediction.data.columns == ["idx", "Real", "Prediction"]
    assert res.processed.preprocessed.columns == ["idx", "feature"]
    assert res.processed.model_input.columns == ["idx", "feature"]
    assert res.processed.selected_features == ("feature",)
    assert res.processed.preprocessed.count() == 10


def test_holdout_and_cross_validation(base):
    res = W.validate(base, ValidationConfig(cfg(base), "Last split", 20))
    assert res.prediction.data.count() == 4 and res.metrics.r2 is not None
    cv = W.validate(base, ValidationConfig(cfg(base, model=ModelSpec("linear_regression")), "Cross-validation", folds=5))
    d = cv.prediction.data.orderBy("Real").toPandas()
    assert len(d) == 20 and list(d["Real"]) == [float(2 * v) for v in range(20)]
    assert np.allclose(d["Prediction"], d["Real"])


def test_prediction_rejects_missing_features(base):
    res = W.train(base, TrainingConfig(cfg(base), "Random percent", 100))
    with pytest.raises(ValueError, match="Missing required feature"):
        W.predict(res.artifact, base.select("row", "target"))


def test_artifact_round_trip_and_unlabeled_prediction(base, spark, tmp_path):
    res = W.train(base, TrainingConfig(cfg(base), "Random percent", 100))
    art = deserialize_artifact(serialize_artifact(res.artifact))
    processed, pred = W.predict(art, base.select("row", "feature"))
    assert pred.data.columns == ["idx", "Prediction"] and pred.metrics is None
    a = pred.data.orderBy("idx").toPandas()["Prediction"]
    b = W.predict(res.artifact, base.select("row", "feature"))[1].data.orderBy("idx").toPandas()["Prediction"]
    assert np.allclose(a, b)
    from regcast.sources.artifacts import load_artifact, save_artifact

    save_artifact(res.artifact, str(tmp_path / "model"), spark)
    again = load_artifact(spark, str(tmp_path / "model"))
    c = W.predict(again, base.select("row", "feature"))[1].data.orderBy("idx").toPandas()["Prediction"]
    assert np.allclose(a, c)


def test_artifact_version_and_kind_checks(base):
    import json

    res = W.train(base, TrainingConfig(cfg(base, model=ModelSpec("linear_regression")), "Random percent", 100))
    doc = json.loads(serialize_artifact(res.artifact))
    doc["version"] = 99
    with pytest.raises(ValueError, match="Unsupported artifact version"):
        deserialize_artifact(json.dumps(doc))
    with pytest.raises(ValueError, match="not a model artifact"):
        deserialize_artifact("[1, 2]")


def test_feature_selection_between_preprocessing_and_model(base):
    data = base.withColumn("noise", (F.col("row") % 3).cast("double"))
    c = cfg(data, ("feature", "noise"), feature_selection=FeatureSelection("F Regression", 1))
    res = W.train(data, TrainingConfig(c, "Random percent", 100))
    assert res.artifact.selected == ["feature"]
    processed, pred = W.predict(res.artifact, data.where(F.col("row") >= 16))
    assert pred.data.count() == 4
    assert len(processed.preprocessed.columns) == 3 and len(processed.model_input.columns) == 2


def test_processed_data_contains_encoded_names(spark):
    pdf = pd.DataFrame({"row": range(20), "number": [float(v) for v in range(20)], "category": ["a", "b"] * 10, "target": [2.0 * v for v in range(20)]})
    data = spark.createDataFrame(pdf)
    res = W.train(data, TrainingConfig(cfg(data, ("number", "category")), "Random percent", 100))
    cols = res.processed.preprocessed.columns
    assert "category_a" in cols and "category_b" in cols and "number" in cols


def test_lookback_lags_after_selection(base):
    data = base.withColumn("noise", (F.col("row") % 3).cast("double"))
    c = cfg(data, ("feature", "noise"), feature_selection=FeatureSelection("F Regression", 1), lookback=3)
    res = W.train(data, TrainingConfig(c, "Last percent", 80), data.where(F.col("row") >= 16))
    assert res.processed.selected_features[-3:] == ("target_lag_1", "target_lag_2", "target_lag_3")
    assert len(res.processed.model_input.columns) == 1 + 4


def test_lookback_rejects_random_rows(base):
    with pytest.raises(ValueError, match="last contiguous"):
        W.train(base, TrainingConfig(cfg(base, lookback=2), "Random percent", 100))


def test_lookback_prediction_resets_history(base):
    res = W.train(base, TrainingConfig(cfg(base, model=ModelSpec("linear_regression"), lookback=2), "Last percent", 100))
    art = deserialize_artifact(serialize_artifact(res.artifact))
    tail = base.where(F.col("row") >= 17).select("row", "feature")
    a = W.predict(art, tail)[1].data.orderBy("idx").toPandas()["Prediction"].to_numpy()
    b = W.predict(art, tail)[1].data.orderBy("idx").toPandas()["Prediction"].to_numpy()
    assert np.allclose(a, b)


def test_lookback_recursion_uses_history_then_predictions(spark):
    pdf = pd.DataFrame({"row": range(6), "feature": [0.0] * 6, "target": [1.0, 2, 3, 5, 8, 13]})
    df = spark.createDataFrame(pdf)
    c = PipelineConfig(("feature",), "target", ("row",), [("feature", "Numeric", "None", 1)], ModelSpec("linear_regression"), lookback=2)
    fitted = W.fit_pipeline(W._index(df, c), c)
    assert fitted.history == [8.0, 13.0]
    test = spark.createDataFrame(pd.DataFrame({"row": range(3), "feature": [0.0] * 3}))
    from regcast.operators.recursive import _recursive_frame
    from regcast.operators.rowindex import with_row_index

    ix = with_row_index(test, ["row"])
    fr = _recursive_frame(fitted, ix.df, ["idx"]).orderBy("idx").toPandas()
    p = fr["_ps"].to_numpy()
    assert list(fr.iloc[0][["target_lag_1", "target_lag_2"]]) == [13.0, 8.0]
    assert np.allclose(fr.iloc[1][["target_lag_1", "target_lag_2"]].to_numpy(dtype=float), [p[0], 13.0])
    assert np.allclose(fr.iloc[2][["target_lag_1", "target_lag_2"]].to_numpy(dtype=float), [p[1], p[0]])
    m = fitted.model
    assert p[0] == pytest.approx(m.intercept + m.coef[0] * 0 + m.coef[1] * 13 + m.coef[2] * 8)


def test_known_history_scoring(spark):
    pdf = pd.DataFrame({"row": range(8), "feature": [0.0] * 8, "target": [1.0, 2, 3, 5, 8, 13, 21, 34]})
    df = spark.createDataFrame(pdf)
    c = PipelineConfig(("feature",), "target", ("row",), [("feature", "Numeric", "None", 1)], ModelSpec("linear_regression"), lookback=2)
    from regcast.operators.recursive import known_history_predict
    from regcast.operators.rowindex import Indexed, with_row_index

    ix = with_row_index(df, ["row"])
    tr = Indexed(ix.df.where(F.col("idx") < 6), 6, "idx")
    fitted = W.fit_pipeline(tr, c)
    te = ix.df.where(F.col("idx") >= 6).withColumn("idx", F.col("idx") - 6)
    got = known_history_predict(fitted, tr, te, keep=["idx"]).orderBy("idx").toPandas()["Prediction"].to_numpy()
    m = fitted.model
    exp = [m.intercept + m.coef[1] * 13 + m.coef[2] * 8, m.intercept + m.coef[1] * 21 + m.coef[2] * 13]
    assert np.allclose(got, exp)


def test_lookback_cross_validation_uses_time_series_folds(base):
    res = W.validate(base, ValidationConfig(cfg(base, lookback=2), "Cross-validation", folds=4))
    d = res.prediction.data.orderBy("idx").toPandas()
    assert len(d) == 16 and list(d["Real"]) == [2.0 * v for v in range(4, 20)]


def test_target_processing_inverse_and_lookback_lags(base):
    res = W.train(base, TrainingConfig(cfg(base, target_processing="StandardScaler"), "Last percent", 100), base.where(F.col("row") >= 17))
    assert res.prediction.data.agg(F.max("Prediction")).first()[0] > 1.0
    res = W.train(base, TrainingConfig(cfg(base, target_processing="MinMaxScaler", lookback=2), "Last percent", 100), base.where(F.col("row") >= 18))
    lags = res.processed.model_input.select("target_lag_1", "target_lag_2").toPandas().to_numpy()
    assert np.all((lags >= 0.0) & (lags <= 1.0))
    assert res.prediction.data.agg(F.max("Prediction")).first()[0] > 1.0


@pytest.mark.parametrize("tp,lb,name", [("None", None, "model__n_estimators"), ("None", 2, "model__estimator__n_estimators"),
                                        ("StandardScaler", 2, "model__regressor__estimator__n_estimators")])
def test_grid_search_parameter_names(base, tp, lb, name):
    spec = ModelSpec("random_forest", {"n_estimators": 10, "max_depth": 3}, True, {"model__n_estimators": [2, 3]}, 3)
    sel = "Last percent" if lb else "Random percent"
    res = W.train(base, TrainingConfig(cfg(base, model=spec, target_processing=tp, lookback=lb), sel, 100))
    assert name in res.grid_search.best_parameters


def test_grid_search_rejects_empty_lists(base):
    spec = ModelSpec("ridge", {}, True, {"model__alpha": []}, 3)
    with pytest.raises(ValueError, match="at least one value"):
        W.train(base, TrainingConfig(cfg(base, model=spec), "Random percent", 100))


def test_voting_regressor_trains_and_tunes_nested_names(base):
    spec = ModelSpec("voting_regressor", {"estimators": ["linear_regression", "decision_tree", "ridge"]}, True,
                     {"model__decision_tree__max_depth": [2, 3]}, 3)
    res = W.train(base, TrainingConfig(cfg(base, model=spec), "Random percent", 100))
    assert "model__decision_tree__max_depth" in res.grid_search.best_parameters


def test_streaming_scoring_matches_batch(base, spark, tmp_path):
    from regcast.streaming.scoring import score_stream

    res = W.train(base, TrainingConfig(cfg(base, model=ModelSpec("ridge")), "Random percent", 100))
    src = str(tmp_path / "in")
    base.write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)
    q = score_stream(res.artifact, stream, keep=["row"]).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored").orderBy("row").toPandas()["Prediction"].to_numpy()
    ref = res.artifact.predict(base, keep=["row"]).orderBy("row").toPandas()["Prediction"].to_numpy()
    assert np.allclose(got, ref)


def test_parallel_linear_scan_equals_sequential_recursion(spark, monkeypatch):
    from regcast.operators import recursive as R
    from regcast.operators.rowindex import with_row_index

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"row": range(120), "x": rng.normal(size=120)})
    pdf["target"] = np.cumsum(rng.normal(size=120)) * 0.1 + pdf.x
    df = spark.createDataFrame(pdf)
    c = PipelineConfig(("x",), "target", ("row",), [("x", "Numeric", "StandardScaler", 120)], ModelSpec("ridge"),
                       lookback=3, target_processing="StandardScaler")
    fitted = W.fit_pipeline(W._index(df, c), c)
    ix = with_row_index(spark.createDataFrame(pd.DataFrame({"row": range(90), "x": rng.normal(size=90)})), ["row"])
    monkeypatch.setattr(R, "SCAN_BLOCK", 17)
    fast = R._recursive_frame(fitted, ix.df, ["idx"]).orderBy("idx").toPandas()
    monkeypatch.setattr(R, "_linear_parts", lambda f: None)
    slow = R._recursive_frame(fitted, ix.df, ["idx"]).orderBy("idx").toPandas()
    assert np.allclose(fast["_ps"], slow["_ps"], atol=1e-12)
    lags = ["target_lag_1", "target_lag_2", "target_lag_3"]
    assert np.allclose(fast[lags].to_numpy(), slow[lags].to_numpy(), atol=1e-12)


@pytest.mark.parametrize("key,params,tp,scaling", [
    ("ridge", {"alpha": 3.0}, "StandardScaler", None),
    ("lasso", {"alpha": 0.5}, "MinMaxScaler", "MinMaxScaler"),
    ("bayesian_ridge", {}, "None", None),
])
def test_fold_additive_cv_equals_per_fold_refits(spark, key, params, tp, scaling, monkeypatch):
    from regcast.functions.profile import override_plan
    from regcast.plans import fastcv

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": range(200), "x": rng.normal(size=200) * 3 + 5, "cat": rng.choice(["a", "b", "c"], 200)})
    pdf["target"] = 2 * pdf.x + (pdf.cat == "b") * 1.5 + rng.normal(size=200)
    df = spark.createDataFrame(pdf)
    plan = preprocessing_plan(df, ["x", "cat"])
    if scaling:
        plan = override_plan(plan, scaling=scaling)
    c = PipelineConfig(("x", "cat"), "target", ("k",), plan, ModelSpec(key, params), target_processing=tp)
    fast = W.validate(df, ValidationConfig(c, "Cross-validation", folds=4)).prediction.data.orderBy("idx").toPandas()
    monkeypatch.setattr(fastcv, "eligible", lambda *a, **k: False)
    slow = W.validate(df, ValidationConfig(c, "Cross-validation", folds=4)).prediction.data.orderBy("idx").toPandas()
    assert np.allclose(fast.Prediction, slow.Prediction, atol=1e-9)


def test_fold_additive_grid_scores_equal_per_fold_refits(spark, monkeypatch):
    from regcast.plans import fastcv

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": range(150), "x": rng.normal(size=150), "z": rng.normal(size=150)})
    pdf["target"] = pdf.x - 0.5 * pdf.z + rng.normal(scale=0.5, size=150)
    df = spark.createDataFrame(pdf)
    spec = ModelSpec("ridge", {}, True, {"model__alpha": [0.1, 10.0, 100.0]}, 3)
    c = PipelineConfig(("x", "z"), "target", ("k",), preprocessing_plan(df, ["x", "z"]), spec)
    fast = W.train(df, TrainingConfig(c, "Random percent", 100)).grid_search
    monkeypatch.setattr(fastcv, "eligible", lambda *a, **k: False)
    slow = W.train(df, TrainingConfig(c, "Random percent", 100)).grid_search
    assert fast.best_parameters == slow.best_parameters
    assert np.allclose([s for _c, s in fast.scores], [s for _c, s in slow.scores], atol=1e-9)
