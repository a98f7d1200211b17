"""W3 on a stream: score a Structured Streaming DataFrame with a fitted
pipeline.  Without lookback the whole pipeline (encoders, selection,
model, inverse target scaling) is a stateless projection, so it runs per
micro-batch with no state store; recursive (lookback) scoring is ordered
and is rejected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(fitted, stream: DataFrame, keep=()) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame.")
    if fitted.config.lookback:
        raise ValueError("Target lookback needs ordered recursive prediction; score it in batch.")
    missing = [f for f in fitted.features if f not in stream.columns]
    if missing:
        raise ValueError("Missing required feature columns: " + ", ".join(missing))
    from ..operators.neighbors import KNNModel

    if isinstance(fitted.model, KNNModel):
        raise ValueError("knn scoring needs a neighbour join; score it in batch.")
    return fitted.predict(stream, keep=list(keep))
