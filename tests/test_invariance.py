"""Results do not depend on partitioning or input order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regcast.functions.metrics import metrics_frame
from regcast.operators import autocorr
from regcast.operators.rowindex import with_row_index
from regcast.plans import workflows as W
from regcast.plans.config import ModelSpec, PipelineConfig, TrainingConfig, ValidationConfig
from regcast.functions.profile import preprocessing_plan

SF = "/root/testdata/sf0.001"


def layouts(df):
    return [df.repartition(1), df.repartition(7), df.orderBy(F.rand(3)).repartition(5)]


def test_workflow_predictions_are_layout_independent(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    feats = ("p_size", "p_type", "p_brand")
    outs = []
    for df in layouts(part):
        cfg = PipelineConfig(feats, "p_retailprice", ("p_partkey",), preprocessing_plan(part, list(feats)), ModelSpec("ridge"))
        res = W.validate(df, ValidationConfig(cfg, "Random split", 20))
        outs.append(res.prediction.data.orderBy("idx").toPandas()["Prediction"].to_numpy())
    assert all(np.allclose(outs[0], o) for o in outs[1:])


def test_tree_model_is_layout_independent(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    feats = ("p_size", "p_type")
    outs = []
    for df in layouts(part):
        cfg = PipelineConfig(feats, "p_retailprice", ("p_partkey",), preprocessing_plan(part, list(feats)),
                             ModelSpec("random_forest", {"n_estimators": 3, "max_depth": 4}))
        res = W.validate(df, ValidationConfig(cfg, "Last split", 20))
        outs.append(res.prediction.data.orderBy("idx").toPandas()["Prediction"].to_numpy())
    assert all(np.allclose(outs[0], o) for o in outs[1:])


def test_acf_and_metrics_are_layout_independent(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    acfs = [autocorr.acf_values(with_row_index(df, ["ts", "event_id"]), "value", 5) for df in layouts(ev)]
    assert all(np.allclose(acfs[0], a) for a in acfs[1:])
    c = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_acctbal").alias("Real"), (F.col("c_acctbal") * 0.9).alias("Prediction"))
    ms = [metrics_frame(df).first() for df in layouts(c)]
    assert all(np.allclose(list(ms[0]), list(m)) for m in ms[1:])
