"""Small shared pieces: the word definition, column-name hygiene and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from regcast.session import ensure_checkpoint_dir, materialize, ship_package

#: A word is a maximal run of characters other than space and TAB..CR (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest table, in bytes of its rows, that is ever sent to every executor.
BROADCAST_BYTES = 8 << 20


#: Rows of an Arrow batch, where the session keeps Spark's default of 10,000: whole texts are wide rows, and a worker
#: holds a batch several times over.
BATCH_CONF, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the executors and batch size (all idempotent)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name that may hold dots or other signs, as column functions take it."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(fields: list[StructField], *more: tuple[str, DataType]) -> StructType:
    """Columns kept as they are, whatever their names and types, and new ones behind them."""
    return StructType([*[StructField(f.name, f.dataType) for f in fields], *[StructField(n, t) for n, t in more]])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: Spark's own takes a dot for a path."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=[f"c{i}" for i in range(out.num_columns)])

    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, plain).toDF(*schema.names)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def n_words(col: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use, whatever columns it brings (names compare without case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` written to the checkpoint folder, and whether its measured bytes are below ``limit``."""
    df = materialize(df)
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return df, (df.agg(F.sum(width)).first()[0] or 0) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only where the measured size allows it; beyond it the join shuffles."""
    df, ok = small(df, limit)
    return F.broadcast(df) if ok else df
