"""IO4 for every registered regressor: fit → JSON → reload → same predictions."""

import numpy as np
import pandas as pd
import pytest

from regcast.operators.models import REGISTRY
from regcast.plans import workflows as W
from regcast.plans.config import ModelSpec, PipelineConfig, TrainingConfig
from regcast.functions.profile import preprocessing_plan
from regcast.sources.artifacts import deserialize_artifact, serialize_artifact

SMALL = {
    "random_forest": {"n_estimators": 3, "max_depth": 3},
    "extra_trees": {"n_estimators": 3, "max_depth": 3},
    "bagging": {"n_estimators": 2},
    "gradient_boosting": {"n_estimators": 3},
    "hist_gradient_boosting": {"max_iter": 3},
    "xgboost": {"n_estimators": 3},
    "lightgbm": {"n_estimators": 3},
    "catboost": {"iterations": 3},
    "adaboost": {"n_estimators": 3},
    "nu_svr": {"n_landmarks": 50, "max_iter": 20},
    "mlp": {"hidden_layer_sizes": "5", "max_iter": 10},
    "elm": {"n_hidden": 10},
    "voting_regressor": {"estimators": ["ridge", "decision_tree", "elm"]},
}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": range(80), "x": rng.normal(size=80), "c": rng.choice(["a", "b"], 80)})
    pdf["target"] = 3 + pdf.x + (pdf.c == "a") + rng.normal(scale=0.1, size=80)
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("key", sorted(k for k in REGISTRY if k != "knn"))
def test_round_trip_gives_identical_predictions(data, key):
    plan = preprocessing_plan(data, ["x", "c"])
    cfg = PipelineConfig(("x", "c"), "target", ("k",), plan, ModelSpec(key, SMALL.get(key, {})))
    res = W.train(data, TrainingConfig(cfg, "Random percent", 100))
    again = deserialize_artifact(serialize_artifact(res.artifact))
    a = res.artifact.predict(data, keep=["k"]).orderBy("k").toPandas()["Prediction"].to_numpy()
    b = again.predict(data, keep=["k"]).orderBy("k").toPandas()["Prediction"].to_numpy()
    assert np.allclose(a, b)
    assert np.all(np.isfinite(a))


def test_knn_artifact_keeps_its_rows_as_a_table(data, spark, tmp_path):
    from regcast.sources.artifacts import load_artifact, save_artifact

    plan = preprocessing_plan(data, ["x"])
    cfg = PipelineConfig(("x",), "target", ("k",), plan, ModelSpec("knn"))
    res = W.train(data, TrainingConfig(cfg, "Random percent", 100))
    with pytest.raises(ValueError, match="training rows"):
        serialize_artifact(res.artifact)
    save_artifact(res.artifact, str(tmp_path / "knn"), spark)
    again = load_artifact(spark, str(tmp_path / "knn"))
    a = res.artifact.predict(data, keep=["k"]).orderBy("k").toPandas()["Prediction"].to_numpy()
    b = again.predict(data, keep=["k"]).orderBy("k").toPandas()["Prediction"].to_numpy()
    assert np.allclose(a, b)


def test_large_ordinal_vocabulary_is_saved_as_a_table(spark, tmp_path, monkeypatch):
    from regcast.operators import encoders
    from regcast.sources.artifacts import load_artifact, save_artifact

    monkeypatch.setattr(encoders, "MAP_LIMIT", 3)
    pdf = pd.DataFrame({"k": range(60), "code": [f"c{i % 12:02d}" for i in range(60)]})
    pdf["target"] = [float(i % 12) for i in range(60)]
    df = spark.createDataFrame(pdf)
    plan = preprocessing_plan(df, ["code"])  # 12 levels > 10 ⇒ ordinal, above the map limit ⇒ table
    res = W.train(df, TrainingConfig(PipelineConfig(("code",), "target", ("k",), plan, ModelSpec("linear_regression")), "Random percent", 100))
    assert res.artifact.preprocessor.ordinal_tables
    save_artifact(res.artifact, str(tmp_path / "ord"), spark)
    again = load_artifact(spark, str(tmp_path / "ord"))
    a = res.artifact.predict(df, keep=["k"]).orderBy("k").toPandas()["Prediction"].to_numpy()
    b = again.predict(df, keep=["k"]).orderBy("k").toPandas()["Prediction"].to_numpy()
    assert np.allclose(a, b)
