from math import ceil

import pytest
from pyspark.sql import functions as F

from regcast.operators import sampling
from regcast.operators.rowindex import with_row_index


def rows(ix, col="row"):
    return [r[col] for r in ix.df.orderBy(ix.idx).collect()]


def test_row_index_is_exact_and_partition_independent(spark, base):
    for parts in (1, 7):
        ix = with_row_index(base.repartition(parts), ["row"], num_partitions=parts)
        assert ix.n == 20
        assert [(r["idx"], r["row"]) for r in ix.df.orderBy("idx").collect()] == [(i, i) for i in range(20)]


def test_last_percent_selects_final_rows(base):
    ix = sampling.last_percent(with_row_index(base, ["row"]), 25)
    assert rows(ix) == [15, 16, 17, 18, 19]


def test_random_percent_is_reproducible_and_exact_size(base):
    a = sampling.random_percent(base, "row", 40)
    b = sampling.random_percent(base.repartition(5), "row", 40)
    assert a.n == 8 and rows(a) == rows(b)


def test_last_validation_split_preserves_order(base):
    tr, va = sampling.last_split(with_row_index(base, ["row"]), 20)
    assert rows(tr) == list(range(16)) and rows(va) == [16, 17, 18, 19]


def test_random_split_sizes(base):
    tr, te = sampling.random_split(base, "row", 25)
    assert (tr.n, te.n) == (15, 5)
    assert sorted(rows(tr) + rows(te)) == list(range(20))


def test_kfold_sizes_first_folds_larger(spark):
    df = spark.range(23).withColumnRenamed("id", "row")
    ix = sampling.kfold_random(df, "row", 5)
    sizes = sorted((r["fold"], r["count"]) for r in ix.df.groupBy("fold").count().collect())
    assert sizes == [(0, 5), (1, 5), (2, 5), (3, 4), (4, 4)]


def test_expanding_folds_predict_last_rows(base):
    ix = sampling.expanding_folds(with_row_index(base, ["row"]), 4)
    tagged = ix.df.where(F.col("fold").isNotNull())
    assert tagged.count() == 16
    assert sampling.expanding_fold_bounds(20, 4) == [(4, 8), (8, 12), (12, 16), (16, 20)]


def test_split_argument_errors(base):
    with pytest.raises(ValueError):
        sampling.random_percent(base, "row", 0)
    with pytest.raises(ValueError):
        sampling.last_split(with_row_index(base, ["row"]), 100)
    with pytest.raises(ValueError, match="exceed"):
        sampling.kfold_random(base, "row", 21)


def test_training_row_count_rule():
    assert sampling.training_row_count(20, 40) == 8
    assert sampling.training_row_count(3, 1) == max(1, ceil(3 * 1 / 100))


@pytest.mark.parametrize("listed,digits", [(10_000, 4), (2, 1)])
def test_hash_cuts_equal_the_ranks(spark, monkeypatch, listed, digits):
    """Cuts by counting passes (one digit at a time, buckets of 2 rows at most listed) select what a full sort would."""
    monkeypatch.setattr(sampling, "LISTED", listed)
    monkeypatch.setattr(sampling, "DIGITS", digits)
    df = spark.range(500).selectExpr("id as row", "cast(id % 7 as string) as s").repartition(6)
    order = [r["row"] for r in sampling.shuffled_index(df, ["row", "s"]).df.orderBy("idx").collect()]
    ranks = [0, 1, 2, 77, 250, 499, 500]
    n, cuts = sampling.hash_cuts(df, ["row", "s"], ranks)
    assert n == 500
    for rank, cut in zip(ranks, cuts, strict=True):
        assert {r["row"] for r in df.where(cut).collect()} == set(order[:rank])


def test_splits_and_folds_without_an_index_move_no_row(spark, base):
    df = spark.range(300).withColumnRenamed("id", "row")
    for a, b in zip(sampling.random_split(df, "row", 30), sampling.random_split(df, "row", 30, indexed=False), strict=True):
        assert a.n == b.n and {r["row"] for r in a.df.collect()} == {r["row"] for r in b.df.collect()}
        assert "Exchange" not in b.df._jdf.queryExecution().executedPlan().toString()
    folds = sampling.kfold_random(df, "row", 7, indexed=False)
    want = {r["row"]: r["fold"] for r in sampling.kfold_random(df, "row", 7).df.collect()}
    assert {r["row"]: r["fold"] for r in folds.df.collect()} == want
    assert "Exchange" not in folds.df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sampling.kfold_random(base, "row", 21, indexed=False)
