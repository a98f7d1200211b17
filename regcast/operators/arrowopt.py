"""Distributed loss/gradient for models whose forward pass is NumPy code
(kernel features, neural nets): every call is one Spark job — a
``mapInArrow`` task evaluates the partial loss and gradient of its rows
for the broadcast parameter vector, and ``groupBy(k).sum`` combines the
partials.  Only ``len(theta) + 1`` numbers reach the driver.  A table that
its caller knows to be small can be minimised over in one task (``in_task``).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ArrowObjective:
    """``objective(theta) -> (loss_sum, grad_sum)`` over all rows."""

    def __init__(self, data: DataFrame, p: int, partial: Callable[..., tuple[float, np.ndarray]], weighted: bool):
        self.data, self.p, self.partial, self.weighted = data, p, partial, weighted

    def _columns(self, b) -> list[np.ndarray]:
        """X, y and, where there are any, the rows' weights."""
        X = np.column_stack([b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(self.p)])
        return [X, *[b.column(c).to_numpy(zero_copy_only=False) for c in (("y", "w") if self.weighted else ("y",))]]

    def _sender(self) -> ArrowObjective:
        """What tasks need of this object: all but the table."""
        return ArrowObjective(None, self.p, self.partial, self.weighted)

    def _summed(self, parts, th: np.ndarray):
        acc_f, acc_g = 0.0, np.zeros_like(th)
        for X, y, *w in parts:
            f, g = self.partial(X, y, th, *w)
            acc_f += f
            acc_g += g
        return acc_f, acc_g

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        th, own = np.asarray(theta, dtype=float).copy(), self._sender()

        def run(batches):
            seen = 0

            def parts():
                nonlocal seen
                for b in batches:
                    if b.num_rows:
                        seen += 1
                        yield own._columns(b)

            f, g = own._summed(parts(), th)
            if seen:
                vals = np.concatenate([[f], g])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(vals.size, dtype=np.int64)), pa.array(vals)], names=["k", "v"])

        rows = self.data.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        vec = np.zeros(th.size + 1)
        for r in rows:
            vec[r["k"]] = r["v"]
        return float(vec[0]), vec[1:]

    def in_task(self, train: Callable[[Callable], np.ndarray]) -> np.ndarray:
        """``train(objective)`` by one task that holds all rows; its warnings are repeated on the driver."""
        own = self._sender()

        def whole(batches):
            parts = [own._columns(b) for b in batches if b.num_rows]
            if not parts:
                return
            with warnings.catch_warnings(record=True) as told:
                warnings.simplefilter("always", UserWarning)
                th = train(lambda theta: own._summed(parts, theta))
            said = [str(w.message) for w in told if w.category is UserWarning]
            yield pa.RecordBatch.from_arrays([pa.array([th.tobytes()], pa.binary()), pa.array([said], pa.list_(pa.string()))], names=["theta", "said"])

        found = self.data.coalesce(1).mapInArrow(whole, "theta binary, said array<string>").first()
        if found is None:  # no rows
            return train(lambda theta: (0.0, np.zeros_like(theta)))
        for message in found["said"]:
            warnings.warn(message, stacklevel=2)
        return np.frombuffer(found["theta"], dtype=float).copy()


def arrow_objective(
    df: DataFrame,
    x_cols,
    y_col: str,
    partial: Callable[..., tuple[float, np.ndarray]],
    weight: str | None = None,
) -> ArrowObjective:
    """``partial(X, y, theta) -> (loss_sum, grad_sum)`` over a batch; the column ``weight`` is its last argument where named."""
    x_cols = list(x_cols)
    data = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x_cols)], F.col(y_col).cast("double").alias("y"), *([F.col(weight).alias("w")] if weight else []))
    return ArrowObjective(data, len(x_cols), partial, weight is not None)
