"""Filter interaction audit: what each filter removes in each order of application.

A document fails a set of filters, its mask. In one order it is removed by the
first of these filters, so a step that removes it belongs to a prefix of
filters it passes, followed by one it fails. The orders that share this prefix
are neighbours in lexicographic order: their Lehmer ranks form one interval.
So a (part, mask) adds its count at the interval's start and takes it away at
the end, and a running sum over the ranks gives every order's numbers. The
documents are read once, whatever the number of orders.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from regcast.llm.common import WORD, maybe_broadcast, prepare
from regcast.session import materialize

#: The five filters (fixed values): fewest words, least percentage of different words, highest percentage of capitals, symbols.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
FILTERS = "ABCDE"
MAX_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a text without nulls: does it fail?"""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def lehmer_rank(prefix: tuple[int, ...], k: int) -> int:
    """Lexicographic rank of the first order of 0..k-1 that starts with ``prefix``."""
    return sum(sum(j not in prefix[:i] for j in range(prefix[i])) * factorial(k - 1 - i) for i in range(len(prefix)))


def intervals(mask: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of the orders in which a document of ``mask`` is removed at that step."""
    fails = [i for i in range(k) if mask >> i & 1]
    passes = [i for i in range(k) if not mask >> i & 1]
    for n in range(len(passes) + 1):
        for before in itertools.permutations(passes, n):
            for last in fails:
                start = lehmer_rank((*before, last), k)
                yield n + 1, start, start + factorial(k - n - 1)


def order_effects(counts: DataFrame, filters: str, measures: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, removed_<measure>..., shapley.

    ``counts`` has part, mask (bit i: fails filter i), n and the measures; it may
    repeat a (part, mask). Every part gets a row for every order and step.
    """
    k, spark = len(filters), counts.sparkSession
    if not 1 <= k <= MAX_FILTERS or len(set(filters)) != k:
        raise ValueError(f"1 to {MAX_FILTERS} different filters are needed, not {filters!r}")
    letters = sorted(filters)
    bit = [filters.index(c) for c in letters]
    events = []
    for mask in range(1 << k):
        own = sum(1 << i for i in range(k) if mask >> bit[i] & 1)
        events += [(mask, *e) for e in intervals(own, k)]
    orders = [(rank, step + 1, "".join(order), order[step]) for rank, order in enumerate(itertools.permutations(letters)) for step in range(k)]
    # both tables depend on the number of filters alone
    events = F.broadcast(spark.createDataFrame(events, "mask int, step int, start int, stop int"))
    orders = F.broadcast(spark.createDataFrame(orders, "rank int, step int, filter_order string, filter string"))

    sums = ["n", *measures]
    ends = F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign"))))
    steps = counts.join(events, "mask").select("part", "step", *sums, ends.alias("end")).filter(F.col("end.rank") < factorial(k))
    steps = steps.select("part", "step", "end.rank", *[(F.col(c) * F.col("end.sign")).alias(c) for c in sums])
    bits = [F.col("mask").bitwiseAND(1 << i) != 0 for i in range(k)]
    alone = [F.col("mask") == 1 << i for i in range(k)]

    def per_filter(tests: list[Column]) -> Column:
        return F.create_map(*[x for c, t in zip(filters, tests, strict=True) for x in (F.lit(c), F.sum(F.when(t, F.col("n")).otherwise(0)))])

    facts = materialize(counts.groupBy("part").agg(F.sum("n").alias("total"), per_filter(bits).alias("fails"), per_filter(alone).alias("only")))
    grid = facts.select("part", F.explode(F.sequence(F.lit(0), F.lit(k * factorial(k) - 1))).alias("at"))
    grid = grid.select("part", (F.col("at") % k + 1).alias("step"), F.floor(F.col("at") / k).cast("int").alias("rank"), *[F.lit(0).cast("long").alias(c) for c in sums])

    # one shuffle by part serves the sums and all three windows; a part has k * k! rows
    cells = steps.unionByName(grid).repartition("part").groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    ranks = W.Window.partitionBy("part", "step").orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0)
    upto = W.Window.partitionBy("part", "rank").orderBy("step").rowsBetween(W.Window.unboundedPreceding, 0)
    cells = cells.withColumns({c: F.sum(c).over(ranks) for c in sums}).join(orders, ["rank", "step"])
    cells = cells.withColumns({"gone": F.sum("n").over(upto), "shapley": F.sum("n").over(W.Window.partitionBy("part", "filter"))})
    known = cells.join(maybe_broadcast(facts), "part")
    return known.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails")[F.col("filter")] - F.col("n")).alias("redundant"), F.col("only")[F.col("filter")].alias("unique_fails"),
        *[F.col(c).alias(f"removed_{c}") for c in measures], "shapley",
    )


def mask_counts(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "source", id_col: str = "doc_id", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail, counted without their texts.

    Identical texts share a SHA-256 digest. Rows are summed by digest first, so
    a text that a third of all documents hold is a few rows when its smallest
    id is looked up.
    """
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    failures = text_failures(text)
    mask = sum((F.when(failures[c], 1 << i).otherwise(0) for i, c in enumerate(FILTERS[:-1])), F.lit(0))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), mask.alias("mask"))
    flags = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(good).alias("good"), F.max(toxic).alias("toxic"))
    slim = slim.join(maybe_broadcast(flags), "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    key = ["same", "mask", "part", "good", "toxic"]
    rows = slim.groupBy(*key, "id").agg(F.count("*").alias("n"))  # repeated rows are one
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    firsts = F.min("least.id").over(W.Window.partitionBy("same"))
    # the rows of the smallest id, and those that have none, repeat no earlier document
    fresh_rows = F.col("nameless") + F.when(F.col("least.id") == firsts, F.col("least.n")).otherwise(0)
    texts = texts.withColumn("new", fresh_rows)
    copy = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("new").alias("n")), F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), (F.col("n") - F.col("new")).alias("n")))).alias("m")
    flat = texts.select("part", "good", "toxic", split).filter("m.n > 0").select("part", "m.mask", "m.n", "good", "toxic")
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row per part, order of ABCDE and step, zeros included. A null text is
    read as empty, a null part as ''. Every row counts; rows of one id share its
    labels, and a label given several times holds if any of its rows says so.
    E compares ids: a document fails it if a smaller id has the same text, so
    repeated rows of the smallest id pass, and a null id neither fails E nor
    makes others fail. Documents without a label are neither good nor toxic. An
    empty table has no part, hence no row. Other columns are never read.
    """
    prepare(docs.sparkSession)
    counts = materialize(mask_counts(docs, labels, text_col, part_col, id_col))  # at most 32 rows a part
    out = order_effects(counts, FILTERS, ["good", "toxic"])
    return out.withColumnsRenamed({"removed_good": "good_lost", "removed_toxic": "toxic_lost"}).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
