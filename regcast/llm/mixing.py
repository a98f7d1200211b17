"""Mixing sources to target weights: hash-random order, ranged prefix sums, an exact cut per source.

Every document gets a hash-random key. Within a source the key space is cut
into ranges of about ``RANGE_ROWS`` documents (a hot source has more ranges).
Prefix sums of the ranges' token counts find the range in which the budget
ends, and a prefix sum over that one range finds the document. The plan is one
row per source, so applying it to the documents (with their texts) moves no
text: a document's share follows from its own key and its source's cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from regcast.llm.common import fresh, n_words, prepare, quoted
from regcast.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 1_000
KEY_BITS = 60
#: A mix names a weight for each source; longer lists are refused before they reach the driver.
MAX_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of sum(sizes) by weight; none above ``max_epochs`` times its size, the excess reshared by weight.

    Resharing until none is above ends where a level x gives
    sum(min(max_epochs * size, x * weight)) = sum(sizes): sources fill up in
    the order of max_epochs * size / weight.
    """
    total, weight = sum(sizes), sum(weights)
    left, out = total, [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (max_epochs * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        cap = max_epochs * sizes[i]
        if weight and cap * weight <= left * weights[i]:
            out[i] = float(cap)
            left, weight = left - cap, weight - weights[i]
        else:
            for j in order[at:]:
                out[j] = left / weight * weights[j]
            break
    return out


def random_key(identity: Column) -> Column:
    """The first 60 bits of the MD5 as a long: hash-random, and the same on every engine."""
    return F.conv(F.substring(F.md5(identity), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", size: Column | None = None, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target`` and ``taken`` (tokens the mix takes, repeats counted).

    Sources, by code point with null last, get ``weights`` in turn. A source
    whose target is e whole epochs and a rest takes every document e times and
    then, in the order of (key, size), documents until the rest is used up; the
    document on the cut is taken in part. Rows that agree in id, text and size
    are ties: those on the cut share what is left of the budget equally,
    rounded down. A null text has size 0; null ids and null sources are
    ordinary values; an empty table gives an empty result. A clashing column
    of ``docs`` keeps its name and the new one gets a ``_`` behind it.
    """
    spark = docs.sparkSession
    prepare(spark)
    size_c, source_size, target, taken, key = fresh(docs, "size", "source_size", "target", "taken", "_key")
    ranked = fresh(docs, "_source", "_full", "_rest", "_cut_key", "_cut_size", "_ties")
    words = n_words(F.col(quoted(text_col))) if size is None else size.cast("long")
    keyed = docs.withColumns({size_c: words, key: random_key(F.concat_ws("|", F.lit(seed), F.col(quoted(id_col)), F.col(quoted(text_col))))})
    slim = materialize(keyed.select(F.col(quoted(source_col)).alias("source"), F.col(key).alias("key"), F.col(size_c).alias("size")))

    per = slim.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    per.sort(key=lambda r: (r["source"] is None, str(r["source"] or "")))
    goal = targets([r["s"] for r in per], [weights[i % len(weights)] for i in range(len(per))], max_epochs)
    plan = []
    for r, t in zip(per, goal, strict=True):
        full = min(max_epochs, math.floor(t / r["s"])) if r["s"] else 0
        plan.append((r["source"], r["s"], t, full, int(t - full * r["s"]) if full < max_epochs else 0, -(-r["n"] // RANGE_ROWS)))
    kind = docs.schema[source_col].dataType.simpleString()
    sources = spark.createDataFrame(plan, f"source {kind}, source_size long, target double, full int, rest long, ranges int")

    at = F.least(F.col("ranges") - 1, F.floor(F.col("key") / F.lit(2.0**KEY_BITS) * F.col("ranges")))
    s = sources.select(F.col("source").alias("src"), "rest", "ranges").filter("rest > 0")
    dealt = slim.join(F.broadcast(s), F.col("source").eqNullSafe(F.col("src"))).select("src", "rest", "key", "size", at.alias("range"))
    before = W.Window.partitionBy("src").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("src", "rest", "range").agg(F.sum("size").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    last = ranges.filter("before < rest and rest <= before + held").select(F.col("src").alias("s2"), F.col("range").alias("r2"), "before")
    inside = dealt.join(F.broadcast(last), F.col("src").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    ties = inside.groupBy("src", "rest", "before", "key", "size").agg(F.count("*").alias("ties"))
    upto = W.Window.partitionBy("src").orderBy("key", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    summed = ties.withColumn("lead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("ties")).over(upto), F.lit(0)))
    cut = summed.filter("lead < rest and rest <= lead + size * ties").select("src", (F.col("rest") - F.col("lead")).alias("left"), "key", "size", "ties")

    table = sources.join(cut, F.col("source").eqNullSafe(F.col("src")), "left").select(
        F.col("source").alias(ranked[0]), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("full").alias(ranked[1]),
        F.floor(F.col("left") / F.col("ties")).alias(ranked[2]), F.col("key").alias(ranked[3]), F.col("size").alias(ranked[4]),
    )
    rows = materialize(table)  # one row per source: at most MAX_SOURCES
    me, cut_at = F.struct(F.col(key), F.col(size_c)), F.struct(F.col(ranked[3]), F.col(ranked[4]))
    part = F.when(F.col(ranked[3]).isNull(), F.lit(0)).when(me < cut_at, F.col(size_c)).when(me == cut_at, F.col(ranked[2])).otherwise(0)
    joined = keyed.join(F.broadcast(rows), F.col(quoted(source_col)).eqNullSafe(F.col(ranked[0])), "left")
    return joined.withColumn(taken, (F.col(ranked[1]) * F.col(size_c) + part).cast("long")).drop(key, *ranked[:5])
