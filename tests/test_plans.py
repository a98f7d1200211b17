"""Scale properties read off the physical plans."""

import pandas as pd
import pytest

from regcast.operators.lags import with_lags
from regcast.operators.rowindex import with_row_index
from regcast.operators.encoders import Preprocessor
from regcast.functions.profile import preprocessing_plan

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lags_never_use_a_single_partition_window(spark):
    ix = with_row_index(spark.range(1000).withColumnRenamed("id", "t").selectExpr("t", "t * 2.0 AS v"), ["t"])
    p = plan_text(with_lags(ix.df, "v", [1, 2], idx="idx"))
    assert "Window" in p
    assert "SinglePartition" not in p
    assert "hashpartitioning(__lagwb" in p


def test_row_index_uses_range_partitioning_not_a_global_window(spark):
    df = spark.range(1000).withColumnRenamed("id", "t")
    ix = with_row_index(df, ["t"])
    p = plan_text(ix.df)
    assert "SinglePartition" not in p and "Window" not in p


def test_encoder_projection_prunes_the_scan(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    pre = Preprocessor.fit(part, preprocessing_plan(part, ["p_type", "p_size"]), ["p_type", "p_size"])
    p = plan_text(pre.transform(part, keep=["p_partkey"]))
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string,p_size:int>" in p
    assert "WholeStageCodegen" in p or "*(" in p


def test_filters_reach_the_parquet_scan(spark):
    from pyspark.sql import functions as F

    li = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_quantity") > 10).select("l_quantity")
    p = plan_text(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
