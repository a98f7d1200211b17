"""Row selection, splits and folds.

All randomness is a seeded ``md5`` rank of a unique key, so results are
exact-size, reproducible on any partitioning and checkable in SQL.  Sizes
follow the reference: ``max(1, ceil(n*p/100))`` training rows, test share
``ceil(n*p/100)``, K folds whose first ``n mod k`` are one row larger,
expanding time-series folds with test size ``n // (k+1)``.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowindex import Indexed, with_row_index

SEED = 42
# The texts of the errors below.


def seeded_hash(keys, seed: int = SEED) -> Column:
    """``md5('<k1>|<k2>|…|<seed>')`` — identical in Spark and DuckDB."""
    if isinstance(keys, str):
        keys = [keys]
    parts: list[Column] = []
    for k in keys:
        parts += [F.col(k).cast("string"), F.lit("|")]
    parts.append(F.lit(str(seed)))
    return F.md5(F.concat(*parts))


DIGITS = 4  # hex digits of the hash that one counting pass tells apart
LISTED = 10_000  # rows of a bucket that are listed one by one


def hash_cuts(df: DataFrame, key, ranks, seed: int = SEED) -> tuple[int, list[Column]]:
    """The number of rows, and for each rank a condition that holds for exactly that many rows: the first ones by (hash, key).

    Counting passes over hash prefixes, combined before they are shuffled, find
    the bucket of each rank; a bucket small enough is listed. ``ranks`` may be a
    function of the number of rows. The rows are neither sorted nor moved: the
    condition is a comparison with a literal. Keys must be unique; rows of one
    key fall on the same side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    h = seeded_hash(keys, seed)
    digits = DIGITS
    counts = sorted(df.groupBy(F.substring(h, 1, digits).alias("p")).count().collect())
    n = sum(r["count"] for r in counts)
    ranks = ranks(n) if callable(ranks) else list(ranks)
    open_ranks = {r: r for r in ranks if 0 < r < n}  # rank -> rank inside its bucket
    cuts: dict[int, Column] = {r: F.lit(r >= n) for r in ranks if not 0 < r < n}
    me = F.struct(h, *[F.col(k) for k in keys])
    below = {"": [(c["p"], c["count"]) for c in counts]}
    at = dict.fromkeys(open_ranks, "")
    while open_ranks:
        size = {}
        for r, left in open_ranks.items():
            for prefix, count in below[at[r]]:
                if left < count:
                    at[r], open_ranks[r], size[r] = prefix, left, count
                    break
                left -= count
        small = [r for r in open_ranks if size[r] <= LISTED or digits >= 32]
        if small:
            wanted = sorted({at[r] for r in small})
            rows = df.where(F.substring(h, 1, digits).isin(wanted)).select(h.alias("_h"), *keys).distinct().collect()
            found: dict[str, list] = {}
            for row in sorted(rows, key=tuple):
                found.setdefault(row["_h"][:digits], []).append(row)
            for r in small:
                row = found[at[r]][min(open_ranks.pop(r), len(found[at[r]]) - 1)]
                cuts[r] = me < F.struct(F.lit(row["_h"]), *[F.lit(row[k]).cast(df.schema[k].dataType) for k in keys])
        if open_ranks:
            prefixes = sorted({at[r] for r in open_ranks})
            digits += DIGITS
            below = {p: [] for p in prefixes}
            finer = df.where(F.substring(h, 1, digits - DIGITS).isin(prefixes)).groupBy(F.substring(h, 1, digits).alias("p")).count().collect()
            for c in sorted(finer):
                below[c["p"][: digits - DIGITS]].append((c["p"], c["count"]))
    return n, [cuts[r] for r in ranks]


def shuffled_index(df: DataFrame, key, seed: int = SEED, idx_col: str = "idx") -> Indexed:
    """Rank rows by the seeded hash (ties broken by the key itself)."""
    keys = [key] if isinstance(key, str) else list(key)
    h = "_h"
    ranked = with_row_index(df.withColumn(h, seeded_hash(keys, seed)), [h, *keys], idx_col)
    return Indexed(ranked.df.drop(h), ranked.n, idx_col)


def _check_rows(n: int, percent: int, lo: int, hi: int, what: str) -> None:
    if not lo <= percent <= hi:
        raise ValueError(f"{what} percent must be between {lo} and {hi}.")


def training_row_count(n: int, percent: int) -> int:
    return max(1, ceil(n * percent / 100))


def random_percent(df: DataFrame, key, percent: int, seed: int = SEED) -> Indexed:
    """R2: exactly ``max(1, ceil(n*p/100))`` rows in seeded random order; only these rows are sorted."""
    n, (chosen,) = hash_cuts(df, key, lambda n: [training_row_count(n, percent)], seed)
    if n == 0:
        raise ValueError("The training dataset is empty.")
    _check_rows(n, percent, 1, 100, "Training")
    return shuffled_index(df.where(chosen), key, seed)


def last_percent(ix: Indexed, percent: int) -> Indexed:
    """The final ``ceil(n*p/100)`` rows in order, re-indexed from 0."""
    if ix.n == 0:
        raise ValueError("The training dataset is empty.")
    _check_rows(ix.n, percent, 1, 100, "Training")
    m = training_row_count(ix.n, percent)
    start = ix.n - m
    out = ix.df.where(F.col(ix.idx) >= start).withColumn(ix.idx, F.col(ix.idx) - start)
    return Indexed(out, m, ix.idx)


def select_training_rows(df_or_ix, method: str, percent: int, *, key=None, order_by=None) -> Indexed:
    if method == "Random percent":
        return random_percent(df_or_ix if isinstance(df_or_ix, DataFrame) else df_or_ix.df, key, percent)
    ix = df_or_ix if isinstance(df_or_ix, Indexed) else with_row_index(df_or_ix, order_by)
    return last_percent(ix, percent)


def random_split(df: DataFrame, key, validation_percent: int, seed: int = SEED, indexed: bool = True) -> tuple[Indexed, Indexed]:
    """The first ``ceil(n*p/100)`` rows by seeded hash are held out.

    ``indexed`` adds each side's rank by hash (a sort of that side); without it
    the rows are only told apart, and no row moves."""
    n, (held,) = hash_cuts(df, key, lambda n: [ceil(n * validation_percent / 100)], seed)
    if n < 2:
        raise ValueError("Validation requires at least two rows.")
    _check_rows(n, validation_percent, 1, 99, "Validation")
    n_test = ceil(n * validation_percent / 100)
    sides = df.where(~held), df.where(held)
    if indexed:
        return tuple(shuffled_index(side, key, seed) for side in sides)
    return Indexed(sides[0], n - n_test), Indexed(sides[1], n_test)


def last_split(ix: Indexed, validation_percent: int) -> tuple[Indexed, Indexed]:
    """Ordered head / tail split."""
    if ix.n < 2:
        raise ValueError("Validation requires at least two rows.")
    _check_rows(ix.n, validation_percent, 1, 99, "Validation")
    n_val = max(1, ceil(ix.n * validation_percent / 100))
    if n_val >= ix.n:
        raise ValueError("The validation split leaves no training rows.")
    cut = ix.n - n_val
    train = ix.df.where(F.col(ix.idx) < cut)
    val = ix.df.where(F.col(ix.idx) >= cut).withColumn(ix.idx, F.col(ix.idx) - cut)
    return Indexed(train, cut, ix.idx), Indexed(val, n_val, ix.idx)


def kfold_of_rank(rank: Column, n: int, k: int) -> Column:
    """Fold id of a 0-based rank: the first ``n mod k`` folds hold one extra row."""
    q, r = divmod(n, k)
    big = r * (q + 1)
    if q == 0:
        return F.floor(rank / F.lit(q + 1)).cast("int")
    return (
        F.when(rank < big, F.floor(rank / F.lit(q + 1)))
        .otherwise(F.lit(r) + F.floor((rank - F.lit(big)) / F.lit(q)))
        .cast("int")
    )


def kfold_sizes(n: int, k: int) -> list[int]:
    q, r = divmod(n, k)
    return [q + 1 if f < r else q for f in range(k)]


def _check_folds(n: int, k: int) -> None:
    if k < 2:
        raise ValueError("Cross-validation needs at least two folds.")
    if k > n:
        raise ValueError("Cross-validation folds cannot exceed the number of rows.")


def kfold_random(df: DataFrame, key, k: int, seed: int = SEED, fold_col: str = "fold", indexed: bool = True) -> Indexed:
    """Shuffled K-fold; ``fold`` is the block of the rank by seeded hash, ``idx`` (if ``indexed``) that rank.

    Without the index the k - 1 cuts between folds tag the rows where they lie."""
    if indexed:
        ix = shuffled_index(df, key, seed)
        _check_folds(ix.n, k)
        return Indexed(ix.df.withColumn(fold_col, kfold_of_rank(F.col(ix.idx), ix.n, k)), ix.n, ix.idx)
    n, cuts = hash_cuts(df, key, lambda n: [sum(kfold_sizes(n, k)[: f + 1]) for f in range(k - 1)] if 2 <= k <= n else [], seed)
    _check_folds(n, k)
    fold = F.lit(k - 1)
    for f in reversed(range(k - 1)):
        fold = F.when(cuts[f], F.lit(f)).otherwise(fold)
    return Indexed(df.withColumn(fold_col, fold.cast("int")), n)


def kfold_contiguous(ix: Indexed, k: int, fold_col: str = "fold") -> Indexed:
    """Unshuffled K-fold = contiguous blocks of the ordered rows."""
    _check_folds(ix.n, k)
    return Indexed(ix.df.withColumn(fold_col, kfold_of_rank(F.col(ix.idx), ix.n, k)), ix.n, ix.idx)


def expanding_fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """(test_start, test_end) per fold of an expanding-window split."""
    if k >= n:
        raise ValueError("Time-series validation folds must be less than the number of rows.")
    size = n // (k + 1)
    if size < 1:
        raise ValueError("Too many folds for the number of rows.")
    first = n - k * size
    return [(first + f * size, first + (f + 1) * size) for f in range(k)]


def expanding_folds(ix: Indexed, k: int, fold_col: str = "fold") -> Indexed:
    """Tag predicted rows with their fold; rows before the first test block get null.

    Fold ``f`` trains on ``idx < test_start(f)`` and predicts its block.
    """
    bounds = expanding_fold_bounds(ix.n, k)
    first, size = bounds[0][0], bounds[0][1] - bounds[0][0]
    fold = F.when(F.col(ix.idx) >= first, F.floor((F.col(ix.idx) - first) / size).cast("int"))
    return Indexed(ix.df.withColumn(fold_col, fold), ix.n, ix.idx)


def gather(ix: Indexed, indices: DataFrame) -> DataFrame:
    """Rows whose index is listed in ``indices`` (column ``idx``)."""
    return ix.df.join(indices.select(F.col(indices.columns[0]).alias(ix.idx)), ix.idx, "left_semi")
