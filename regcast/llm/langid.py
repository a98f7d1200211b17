"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unknown word
falls back to its character n-grams: the longest size of which any n-gram is
known gives the mean of their scores; an unknown one-letter n-gram adds
nothing. A text's score is the sum over its words.

Word and n-gram frequencies are fitted on about ``SAMPLE_DOCS`` labelled
documents of each language, picked by a hash of the id; with that bound the
model has a bounded size and every worker holds it whole. All documents are
predicted, over their whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from regcast.llm.common import fresh, map_arrow, prepare, quoted, schema_of

SAMPLE_DOCS = 400
MAX_LANGUAGES = 1_000
MIN_COUNT = 2  # a word or n-gram seen less often in the whole sample is unknown
SIZES = (4, 3, 2, 1)
SMOOTH = 0.5
CACHE_ROWS = 150_000
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty if the text has no letter."""
    found = WORDS.findall((text or "").lower())
    if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w):
        return found
    return []


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


class Backoff(dict):
    """word -> row of ``rows``; words that the model lacks are scored once and kept until the cache is full (a full cache starts anew)."""

    def __init__(self, model: dict):
        self.known = model["words"], model["grams"]
        self.base = np.asarray(model["word_rows"], np.float64)
        self.gram_rows = np.asarray(model["gram_rows"], np.float64)
        self.rows = np.zeros((len(self.base) + CACHE_ROWS, self.base.shape[1]))
        self.rows[: len(self.base)] = self.base
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.known[0])
        self.next = len(self.base)

    def backoff(self, word: str) -> list[int]:
        """Rows of the known n-grams of the longest size that has any."""
        known = self.known[1]
        for size in SIZES:
            hit = [known[g] for g in grams(word, size) if g in known]
            if hit:
                return hit
        return []

    def learn(self, words: set[str]) -> None:
        """Scores words that the cache lacks, all at once."""
        hits = {w: h for w in words if (h := self.backoff(w))}
        sizes = np.fromiter(map(len, hits.values()), np.int64, len(hits))
        first, self.next = self.next, self.next + len(words)
        if hits:
            flat = self.gram_rows[[i for h in hits.values() for i in h]]
            self.rows[first : first + len(hits)] = np.add.reduceat(flat, np.cumsum(sizes) - sizes) / sizes[:, None]
        self.rows[first + len(hits) : self.next] = 0
        self.update(zip(hits, range(first, first + len(hits)), strict=True))
        self.update(zip(words - hits.keys(), range(first + len(hits), self.next), strict=True))

    def score(self, text: str | None) -> np.ndarray | None:
        words = words_of(text)
        if not words:
            return None
        total = np.zeros(self.rows.shape[1])
        for i in range(0, len(words), CACHE_ROWS // 2):
            part = words[i : i + CACHE_ROWS // 2]
            new = {w for w in set(part) if w not in self}
            if self.next + len(new) > len(self.rows):
                self.reset()
                new = {w for w in set(part) if w not in self}
            if new:
                self.learn(new)
            total += self.rows[np.array(list(map(self.__getitem__, part)))].sum(0)
        return total


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str, lang_col: str, id_col: str, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Frequencies per language as log rows: languages, words, word_rows, grams, gram_rows."""
    labelled = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang")).filter("lang is not null and text is not null and id is not null")
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return {"languages": []}
    share = [(r["lang"], languages.index(r["lang"]), int(min(1.0, sample_docs / r["count"]) * (1 << 30))) for r in counts]
    picked = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, k int, share long")), "lang")
    picked = picked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")).select("k", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    seen[k, 0, word] += n
                    for size in SIZES:
                        for g in grams(word, size):
                            seen[k, size, g] += n
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.int32()), pa.array([x[1] for x in keys], pa.int32()), pa.array([x[2] for x in keys], pa.string()), pa.array([seen[x] for x in keys], pa.int64())], names=["k", "size", "item", "n"])

    summed = picked.mapInArrow(tally, "k int, size int, item string, n long").groupBy("size", "item", "k").agg(F.sum("n").alias("n"))
    rows = summed.groupBy("size", "item").agg(F.sum("n").alias("all"), F.collect_list(F.struct("k", "n")).alias("by")).filter(F.col("all") >= MIN_COUNT).toArrow()
    size, item, by = rows.column("size").to_numpy(), rows.column("item").to_pylist(), rows.column("by").to_pylist()
    order = sorted(range(len(item)), key=lambda i: (size[i], item[i]))
    count = np.zeros((len(item), len(languages)))
    for at, i in enumerate(order):
        for e in by[i]:
            count[at, e["k"]] = e["n"]
    size = size[order]
    logs = np.zeros_like(count)
    for s in set(size.tolist()):
        own = size == s
        logs[own] = np.log((count[own] + SMOOTH) / (count[own].sum(0) + SMOOTH * own.sum()))
    names = [item[i] for i in order]
    n_words = int((size == 0).sum())
    return {
        "languages": languages, "words": {w: i for i, w in enumerate(names[:n_words])}, "word_rows": logs[:n_words].astype(np.float32),
        "grams": {g: i for i, g in enumerate(names[n_words:])}, "gram_rows": logs[n_words:].astype(np.float32),
    }


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (the best language's posterior under equal priors).

    Null texts, texts without a letter, and all texts if no language was learned
    get ``und`` and 0. Ties go to the language that sorts first. Rows are
    predicted one by one, whatever their other columns are; a clashing column
    keeps its name and the new one gets a ``_`` behind it.
    """
    prepare(docs.sparkSession)
    pred, score, copy = fresh(docs, "lang_pred", "score", "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value["languages"]
        scorer = Backoff(shared.value) if languages else None
        for b in batches:
            names, sure = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                total = scorer.score(text) if scorer else None
                if total is None:
                    names.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                best = int(total.argmax())
                names.append(languages[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*b.schema.names[:-1], pred, score])

    sent = docs.withColumn(copy, F.col(quoted(text_col)))
    schema = schema_of(docs.schema.fields, (pred, StringType()), (score, DoubleType()))
    return map_arrow(sent, run, schema)


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learns from the documents that are not held out and predicts every document; adds ``held_out`` too."""
    prepare(docs.sparkSession)
    model = train(docs.filter(~held_out(F.col(f"`{id_col}`"))), text_col, lang_col, id_col)
    (held,) = fresh(docs, "held_out")
    return predict(docs.withColumn(held, held_out(F.col(f"`{id_col}`"))), model, text_col)
