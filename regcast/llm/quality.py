"""Quality rules with a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into ``BUCKETS`` buckets. One pass over all
documents counts the buckets of the raw corpus and, in the same pass, those of
the trusted target (documents labelled good). A document's score is the mean,
over its hashed n-grams, of log p_target - log p_raw; documents below a fixed
threshold go. Nothing is sampled, so reruns agree.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from regcast.llm.common import fresh, map_arrow, maybe_broadcast, prepare, quoted, schema_of

BUCKETS = 1 << 14
#: The raw distribution gets one count a bucket; the target gets a prior that follows the raw distribution, of this share of
#: the target's own mass, so that scores keep their scale whatever part of the good documents is labelled.
PRIOR_SHARE = 0.02
#: Share of the target (of its documents that pass the base rules) that may fall below the threshold.
LOSE = 0.05
#: Scores are cut at multiples of this, so the threshold is found from counts of bins.
STEP = 1e-4
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
CACHE_ROWS = 200_000


class Hashes(dict):
    """word -> CRC-32, remembered until the cache is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ROWS:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


def buckets(words: list[bytes], hashes: Hashes) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    h = np.array([hashes[w] for w in words], np.uint64)
    pair = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
    return (np.concatenate([h, pair]) % np.uint64(BUCKETS)).astype(np.int64)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` (a power of two) words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    step = 1
    while step < size:  # numbers of windows twice as long, from pairs of numbers
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measures(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (UTF-8)."""
    solid = text.translate(None, SPACE)
    lines = Counter(text.split(b"\n"))
    dups = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(SPACE))
    return len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), dups, repeated_words(words)


class Ratio:
    """Bucket counts of the raw corpus and the target, and the scores they give."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw, target
        self.n_raw, self.n_target = float(raw.sum()), float(target.sum())
        self.prior = PRIOR_SHARE * self.n_target

    def scores(self, words: list[bytes], hashes: Hashes) -> tuple[float, float]:
        """Score of a document outside the target, and of one in it; its own n-grams count in neither distribution."""
        if not words or not self.n_target:
            return 0.0, 0.0
        at, own = np.unique(buckets(words, hashes), return_counts=True)
        n = int(own.sum())
        p = (self.raw[at] - own + 1) / (self.n_raw - n + BUCKETS)
        prior, target = self.prior * p, self.target[at]
        outside = own @ np.log((target + prior) / p) / n - np.log(self.n_target + self.prior)
        inside = own @ np.log((np.maximum(target - own, 0) + prior) / p) / n - np.log(max(self.n_target - n, 0) + self.prior)
        return float(outside), float(inside)


def _tally(texts: DataFrame) -> np.ndarray:
    """Count of every bucket over the texts (one binary column), summed in Spark."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count = Hashes(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                words = (text or b"").split()
                if words:
                    count += np.bincount(buckets(words, hashes), minlength=BUCKETS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(count[some])})

    summed = texts.mapInArrow(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def _failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def threshold_of(scores: DataFrame, lose: float = LOSE) -> float:
    """The highest multiple of ``STEP`` below which at most ``lose`` of the scores (one column) lie; -inf without scores."""
    col = F.col(scores.columns[0])
    bins = sorted(scores.groupBy(F.floor(col / STEP).alias("bin")).count().collect())  # scores are logarithms: their bins are bounded
    total, below = sum(r["count"] for r in bins), 0
    for r in bins:
        below += r["count"]
        if below > lose * total:
            return r["bin"] * STEP
    return float("-inf")


def quality(docs: DataFrame, good: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """``docs`` without its text, plus the measures, ``base_failed``, ``llr`` and ``kept``.

    ``good`` has the ids of the trusted documents in its first column (nulls
    and repeats are harmless; without any, every score is 0 and decides
    nothing). base_failed: fewer than 20 words, or more than 30 % of them in
    repeated 8-word windows. ``llr`` is the length-normalised log-likelihood
    ratio without the document's own n-grams (0 without words); kept: not
    base_failed and llr >= threshold, by default ``threshold_of`` the target's
    own scores. A null text has no words. Repeated rows each count and each get
    their row; a new column whose name ``docs`` has gets a ``_`` behind it.

    Texts meet the ids of ``good`` only to pick the target; the result joins
    them once the text is gone.
    """
    spark = docs.sparkSession
    prepare(spark)
    (gid,) = fresh(docs, "_gid")
    good = maybe_broadcast(good.select(F.col(quoted(good.columns[0])).alias(gid)).filter(F.col(gid).isNotNull()).distinct())
    same = F.col(quoted(id_col)) == F.col(gid)
    text = F.col(quoted(text_col)).cast("binary").alias("text")
    target = docs.select(F.col(quoted(id_col)), text.alias(fresh(docs.select(quoted(id_col)), "text")[0])).join(good, same, "left_semi")
    target = target.select(F.col(quoted(target.columns[1])).alias("text"))
    shared = spark.sparkContext.broadcast(Ratio(_tally(docs.select(text)), _tally(target)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, hashes = shared.value, Hashes()
        for b in batches:
            got, score = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                words = (text or b"").split()
                got.append(measures(text or b"", words))
                score.append(ratio.scores(words, hashes))
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)] + [pa.array([x[i] for x in score], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[str(i) for i in range(b.num_columns + 6)])

    def scored(rows: DataFrame, names: list[str]) -> DataFrame:
        return map_arrow(rows, run, schema_of(rows.schema.fields[:-1], *[(n, LongType()) for n in names[:5]], *[(n, DoubleType()) for n in names[5:7]]))

    if threshold is None:
        own = scored(target, ["n", "chars", "symbols", "lines", "repeat", "outside", "inside"])
        threshold = threshold_of(own.filter(~_failed(F.col("n"), F.col("repeat"))).select("inside"))
    rest = [c for c in docs.columns if c != text_col]
    new = fresh(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    (inside,) = fresh(docs, "_inside")
    out = scored(docs.select(*map(quoted, rest), F.col(quoted(text_col)).cast("binary")), [*new[:6], inside]).join(good, same, "left")
    out = out.withColumn(new[5], F.when(F.col(gid).isNull(), F.col(new[5])).otherwise(F.col(inside))).drop(inside, gid)
    return out.withColumn(new[6], _failed(F.col(new[0]), F.col(new[4]))).withColumn(new[7], ~F.col(new[6]) & (F.col(new[5]) >= threshold))
