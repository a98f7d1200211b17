"""A stable, exact, 0-based row index over an explicit ordering.

Spark tables have no implicit row order, so every ordered operator takes the
columns that define it (ties must be broken by a unique key).  The index is
built without a global single-partition window:

1. range-partition on the ordering (sampled bounds split hot first-column
   values across partitions because the full key is sampled), sort inside
   each partition and tag rows with ``monotonically_increasing_id`` (partition
   id in the upper 31 bits);
2. cut lineage with a reliable checkpoint so the two passes below see the
   same partitioning even if executors are lost;
3. count rows per partition (one number per partition reaches the driver)
   and turn the running offsets into a literal array indexed by partition id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_PID_SHIFT = 33
_LOW_MASK = (1 << _PID_SHIFT) - 1


def _order_cols(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


@dataclass(frozen=True)
class Indexed:
    """An indexed table: ``df`` carries column ``idx`` in 0..n-1."""

    df: DataFrame
    n: int
    idx: str = "idx"


def with_row_index(
    df: DataFrame,
    order_by,
    idx_col: str = "idx",
    num_partitions: int | None = None,
) -> Indexed:
    drop_tmp = False
    if order_by is None:
        # no meaningful order: any stable one (materialised below)
        df = df.withColumn("_mid", F.monotonically_increasing_id())
        order_by, drop_tmp = ["_mid"], True
    order = _order_cols(order_by)
    # without an explicit count AQE sizes the range partitions from the data
    # (advisory partition size), so tiny inputs do not fan out to hundreds of
    # tasks and huge ones still spread over the cluster
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = ranged.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    tagged = materialize(tagged)
    counts = (
        tagged.groupBy(F.shiftright("_m", _PID_SHIFT).alias("_p")).count().collect()
    )
    per_part = {int(r["_p"]): int(r["count"]) for r in counts}
    n_parts = (max(per_part) + 1) if per_part else 0
    offsets, running = [], 0
    for p in range(n_parts):
        offsets.append(running)
        running += per_part.get(p, 0)
    if n_parts == 0:
        out = tagged.drop("_m").withColumn(idx_col, F.lit(0).cast("long"))
        return Indexed(out, 0, idx_col)
    offset_col = F.element_at(
        F.array(*[F.lit(o).cast("long") for o in offsets]),
        (F.shiftright("_m", _PID_SHIFT) + 1).cast("int"),
    )
    out = tagged.withColumn(
        idx_col, offset_col + F.col("_m").bitwiseAND(F.lit(_LOW_MASK))
    ).drop("_m")
    if drop_tmp:
        out = out.drop("_mid")
    return Indexed(out, running, idx_col)
