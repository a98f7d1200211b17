"""Profiling and the preprocessing plan table (PR1, PR2, PR3).

The plan is a small DataFrame with the reference's columns
``Variable, Type, Unique Count, Preprocessing`` (one row per feature).
The distinct counts come from ONE aggregate pass over the data; a null
counts as one extra value (like a dataframe ``n_unique``).  For very wide
or very high-cardinality inputs ``approx=True`` uses HyperLogLog sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import schema_families, unsupported_columns

# Encoder names and the ordinal rule.
ONE_HOT = "OneHotEncoder"
ORDINAL = "OrdinalEncoder"
STANDARD = "StandardScaler"
MIN_MAX = "MinMaxScaler"
NONE = "None"
ORDINAL_ABOVE = 10  # strings with more distinct values than this are ordinal

PLAN_SCHEMA = T.StructType(
    [
        T.StructField("Variable", T.StringType()),
        T.StructField("Type", T.StringType()),
        T.StructField("Unique Count", T.LongType()),
        T.StructField("Preprocessing", T.StringType()),
    ]
)

_FAMILY_LABEL = {"string": "String", "numeric": "Numeric", "boolean": "Boolean"}


def unique_counts(df: DataFrame, columns, approx: bool = False) -> dict[str, int]:
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        distinct = F.approx_count_distinct(c) if approx else F.count_distinct(c)
        has_null = F.max(F.col(c).isNull().cast("long"))
        aggs.append((distinct + has_null).alias(f"u{i}"))
    row = df.agg(*aggs).first()
    return {c: int(row[f"u{i}"]) for i, c in enumerate(columns)}


def preprocessing_plan(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """PR1: strings first, then numerics, then booleans (each in column order)."""
    columns = list(columns) if columns is not None else df.columns
    bad = unsupported_columns(df, columns)
    if bad:
        raise ValueError("Unsupported feature types for: " + ", ".join(bad))
    fams = schema_families(df, columns)
    counts = unique_counts(df, columns, approx)
    rows = []
    for fam in ("string", "numeric", "boolean"):
        for c in columns:
            if fams[c] != fam:
                continue
            if fam == "string":
                step = ORDINAL if counts[c] > ORDINAL_ABOVE else ONE_HOT
            elif fam == "numeric":
                step = STANDARD
            else:
                step = NONE
            rows.append((c, _FAMILY_LABEL[fam], counts[c], step))
    return df.sparkSession.createDataFrame(rows, PLAN_SCHEMA)


def transformed_feature_count(plan: DataFrame) -> DataFrame:
    """PR2 as a one-row DataFrame: sum(unique if one-hot else 1)."""
    return plan.agg(
        F.sum(
            F.when(F.col("Preprocessing") == ONE_HOT, F.col("Unique Count")).otherwise(F.lit(1))
        ).cast("long").alias("encoded_features")
    )


def override_plan(plan: DataFrame, string_steps: dict[str, str] | None = None, scaling: str = NONE) -> DataFrame:
    """PR3: user edits.  Strings pick OneHot/Ordinal; one scaling choice
    (None / StandardScaler / MinMaxScaler) applies to numerics AND booleans."""
    if scaling not in (NONE, STANDARD, MIN_MAX):
        raise ValueError(f"Unsupported scaling: {scaling}")
    string_steps = string_steps or {}
    for v, s in string_steps.items():
        if s not in (ONE_HOT, ORDINAL):
            raise ValueError(f"Unsupported string preprocessing for {v}: {s}")
    step = F.col("Preprocessing")
    for v, s in string_steps.items():
        step = F.when((F.col("Type") == "String") & (F.col("Variable") == v), F.lit(s)).otherwise(step)
    step = F.when(F.col("Type").isin("Numeric", "Boolean"), F.lit(scaling)).otherwise(step)
    return plan.withColumn("Preprocessing", step).select(*PLAN_SCHEMA.fieldNames())


def plan_steps(plan: DataFrame) -> list[tuple[str, str, str, int]]:
    """The plan rows (feature-sized) as tuples for building expressions."""
    return [
        (r["Variable"], r["Type"], r["Preprocessing"], int(r["Unique Count"]))
        for r in plan.collect()
    ]
