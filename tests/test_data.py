import datetime as dt

import pytest

from regcast.functions import checks, profile
from regcast.sources.tables import read_table


def test_profile_mixed_frame_gives_four_encoded_columns(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "a", True)], "number long, category string, flag boolean")
    plan = profile.preprocessing_plan(df)
    rows = [tuple(r) for r in plan.collect()]
    assert rows == [
        ("category", "String", 2, "OneHotEncoder"),
        ("number", "Numeric", 3, "StandardScaler"),
        ("flag", "Boolean", 2, "None"),
    ]
    assert profile.transformed_feature_count(plan).first()[0] == 4


def test_dates_are_rejected(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "date date")
    with pytest.raises(ValueError, match="Unsupported feature types"):
        profile.preprocessing_plan(df)


def test_nulls_count_as_a_value_in_unique_counts(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "c string")
    assert profile.unique_counts(df, ["c"]) == {"c": 2}


def test_plan_override_scaling_applies_to_numeric_and_boolean(spark):
    df = spark.createDataFrame([(1, "a", True)], "number long, category string, flag boolean")
    plan = profile.override_plan(profile.preprocessing_plan(df), {"category": "OrdinalEncoder"}, scaling="MinMaxScaler")
    steps = {r["Variable"]: r["Preprocessing"] for r in plan.collect()}
    assert steps == {"category": "OrdinalEncoder", "number": "MinMaxScaler", "flag": "MinMaxScaler"}


def test_labeled_data_checks(spark, base):
    with pytest.raises(ValueError, match="at least one feature"):
        checks.validate_labeled_data(base, (), "target")
    with pytest.raises(ValueError, match="Missing required columns"):
        checks.validate_labeled_data(base, ("nope",), "target")
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "x double, y double")
    with pytest.raises(ValueError, match="target contains missing"):
        checks.validate_labeled_data(df, ("x",), "y")
    s = spark.createDataFrame([("a", 1.0)], "x string, y string")
    with pytest.raises(ValueError, match="numeric target"):
        checks.validate_labeled_data(s, ("x",), "y")


def test_series_check_rejects_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    with pytest.raises(ValueError, match="finite"):
        checks.validate_series(df, "v")


def test_read_table_rejects_other_extensions(spark, tmp_path):
    with pytest.raises(ValueError, match="Only CSV and XLSX files are supported"):
        read_table(spark, str(tmp_path / "x.json"))
    with pytest.raises(ValueError, match="convert it to CSV or Parquet"):
        read_table(spark, str(tmp_path / "x.XLSX"))


def test_csv_source_and_prediction_sink_round_trip(spark, base, tmp_path):
    from regcast.sources.tables import write_predictions

    out = str(tmp_path / "pred.csv")
    write_predictions(base.select("row", "target"), out)
    back = read_table(spark, out)
    assert sorted(r["row"] for r in back.collect()) == list(range(20))
