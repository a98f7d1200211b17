"""Table sources and sinks (IO1, IO2, IO3, IO5)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read one table; the format follows the (case-insensitive) extension.

    CSV is read with a header and an inferred schema like the reference's
    loader; Parquet is accepted too.  Spreadsheets are not a cluster format
    and are rejected with the reference's message.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if ext == ".parquet":
        return spark.read.parquet(path)
    if ext == ".xlsx":
        raise ValueError("XLSX is a single-machine spreadsheet format; convert it to CSV or Parquet for Spark.")
    raise ValueError("Only CSV and XLSX files are supported.")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prediction sink: CSV with a header, written by the executors."""
    df.write.mode(mode).option("header", True).csv(path)


def head_rows(indexed: DataFrame, n: int, idx_col: str = "idx") -> DataFrame:
    """First ``n`` rows of an indexed table (R1 index), not a global limit."""
    if n < 0:
        raise ValueError("Row count must be non-negative.")
    return indexed.where(F.col(idx_col) < F.lit(n))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def candidate_features(df: DataFrame, target: str) -> list[str]:
    """Feature candidates exclude the chosen target (IO5)."""
    return [c for c in df.columns if c != target]


def select_frame(df: DataFrame, features, target: str | None = None) -> DataFrame:
    cols = list(features) + ([target] if target else [])
    return df.select(*cols)
