import numpy as np
import pytest

from regcast.functions.metrics import calculate_metrics, long_form
from regcast.operators.encoders import Preprocessor, Scaler


def test_metrics_mape_none_if_zero_in_target(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 8.0), (20.0, 22.0)], "Real double, Prediction double")
    m = calculate_metrics(df)
    assert m.mape is None
    y, p = np.array([0.0, 10, 20]), np.array([5.0, 8, 22])
    assert m.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert m.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert m.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_constant_target_r2(spark):
    perfect = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0)], "Real double, Prediction double")
    off = spark.createDataFrame([(3.0, 3.0), (3.0, 4.0)], "Real double, Prediction double")
    assert calculate_metrics(perfect).r2 == 1.0
    assert calculate_metrics(off).r2 == 0.0


def test_long_form_rows_start_at_one(spark):
    df = spark.createDataFrame([(i, float(i + 1), i + 1.1) for i in range(4)], "idx long, Real double, Prediction double")
    out = sorted(tuple(r) for r in long_form(df).collect())
    assert out[0] == (1, "Prediction", 1.1) and len(out) == 8


def test_encoder_block_order_names_and_unknowns(spark):
    train = spark.createDataFrame([(1.0, "b", "x", True), (3.0, "a", "y", False)], "num double, cat string, ord string, flag boolean")
    plan = [("cat", "String", "OneHotEncoder", 2), ("ord", "String", "OrdinalEncoder", 2), ("num", "Numeric", "StandardScaler", 2), ("flag", "Boolean", "None", 2)]
    pre = Preprocessor.fit(train, plan, ["num", "cat", "ord", "flag"])
    assert pre.output_names() == ["cat_a", "cat_b", "ord", "num", "flag"]
    test = spark.createDataFrame([(2.0, "zz", "zz", True)], "num double, cat string, ord string, flag boolean")
    row = pre.transform(test).first()
    assert (row["cat_a"], row["cat_b"], row["ord"], row["num"], row["flag"]) == (0.0, 0.0, -1.0, 0.0, 1.0)


def test_standard_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    sc = Scaler.fit(df, "x", "StandardScaler")
    x = np.array([1.0, 2, 3, 10])
    assert sc.scale == pytest.approx(x.std(ddof=0))
    assert sc.invert_value(sc.apply_value(7.0)) == pytest.approx(7.0)


def test_zero_range_scales_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert Scaler.fit(df, "x", "MinMaxScaler").scale == 1.0
    assert Scaler.fit(df, "x", "StandardScaler").scale == 1.0
