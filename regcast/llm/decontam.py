"""Benchmark decontamination: a lossless filter on rare words, then Smith-Waterman alignment on words.

1. One pass counts how often each word of the benchmark occurs in the documents.
2. An alignment of the wanted score matches a known least number of an item's
   words. So whichever of the item's words are left out, up to that number less
   ``RARE``, it matches ``RARE`` of the others. Left out are the most frequent.
3. A second pass takes every document with so many rare words of an item near
   each other (the items are broadcast, in blocks of bounded size, so no text is
   shuffled). What of it an alignment of the wanted score can reach is aligned.

Both filters only drop pairs that cannot reach the score, whatever the edits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType

from regcast.llm.common import BROADCAST_BYTES, fresh, map_arrow, prepare, quoted, schema_of

SEED_WORDS, SEED_WINDOW = 3, 3  # least words of an item; the second is read by the tests only
RARE = 4  # rare words of an item that a document must hold
HITS = 1 << 20  # rare words looked at at once
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
CACHE_ROWS = 300_000
PUNCTUATION = re.compile(r"[\W_]+")
UNIT = np.int64(1) << 32  # of a score; the lower half of a cell holds where its alignment starts
NOWHERE = np.int64(2**31)


class Words(dict):
    """Raw token -> word number in the benchmark's vocabulary, -1 if not there, -2 if the token has no letter or digit."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        word = PUNCTUATION.sub("", token)
        if len(self) >= CACHE_ROWS:
            self.clear()
        n = self[token] = self.vocabulary.get(word, -1) if word else -2
        return n

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of a batch of texts, one after the other, and the text that each belongs to."""
        lists = _split(texts)
        tokens = lists.flatten().dictionary_encode()
        number = np.array(list(map(self.__getitem__, tokens.dictionary.to_pylist())), np.int64)
        ids = number[tokens.indices.to_numpy()] if len(number) else number
        text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        return ids[ids != -2], text[ids != -2]


def _split(texts: pa.Array) -> pa.Array:
    return pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))


def plain_words(text: str | None) -> list[str]:
    """White-space tokens, lower-cased, with only their letters and digits."""
    return [w for w in (PUNCTUATION.sub("", t) for t in _split(pa.array([text], pa.string()))[0].as_py()) if w]


class Benchmark:
    """A block of items: vocabulary, items as word numbers, and who has which rare words."""

    def __init__(self, items: list[tuple]):
        words = [plain_words(text) for _, text in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        keep = [i for i, ws in enumerate(words) if len(ws) >= SEED_WORDS]
        self.ids = [items[i][0] for i in keep]
        self.items = [np.array([self.vocabulary[w] for w in words[i]], np.int64) for i in keep]

    def seed(self, frequency: np.ndarray, least: float) -> None:
        """For every word the items that have it among their rare words, and what an alignment of ``least`` needs of each item."""
        size = np.array([len(x) for x in self.items])
        matched = np.maximum(1, np.ceil(least * size - 1e-9).astype(np.int64))  # words that such an alignment matches
        self.need = np.minimum(RARE, matched)
        lost = MATCH * size * (1 - least) / -max(MISMATCH, GAP)  # unmatched words of the text that still leave the score
        self.span = size + (lost + 1e-9).astype(np.int64)
        rare = [np.unique(x[np.lexsort((x, frequency[x]))][:n]) for x, n in zip(self.items, size - matched + self.need, strict=True)]
        word, item = np.concatenate(rare), np.repeat(np.arange(len(rare)), [len(x) for x in rare])
        self.postings = item[np.argsort(word, kind="stable")]
        self.count = np.bincount(word, minlength=len(self.vocabulary) + 1)  # the last one is of unknown words, -1
        self.first = np.cumsum(self.count) - self.count

    def candidates(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Sorted codes, text * items + item, of the pairs with enough rare words within an alignment's span."""
        count, n = self.count[ids], len(self.items)
        total, reach = np.cumsum(count), int(self.span.max())
        found, a = [np.empty(0, np.int64)], 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + HITS, side="right")))
            c = count[a : b + reach]  # spans that start before b end there
            at = np.repeat(np.arange(a, a + len(c)), c)
            item = self.postings[np.arange(len(at)) + np.repeat(self.first[ids[a : a + len(c)]] - np.cumsum(c) + c, c)]
            code = text[at] * n + item
            order = np.argsort(code, kind="stable")
            code, at, item = code[order], at[order], item[order]
            for k in np.unique(self.need).tolist():
                m = max(0, len(code) - k + 1)
                near = (self.need[item[:m]] == k) & (code[:m] == code[k - 1 :]) & (at[k - 1 :] - at[:m] < self.span[item[:m]])
                found.append(np.unique(code[:m][near]))
            a = b
        return np.unique(np.concatenate(found))

    def matches(self, texts: pa.Array, words: Words, least: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, behind the last word) of the items that align with ``least`` or more."""
        ids, text = words.of(texts)
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        value = np.full(len(self.vocabulary) + 1, max(MISMATCH, GAP))
        for code in self.candidates(ids, text).tolist():
            k, i = divmod(code, len(self.items))
            item, own, best = self.items[i], ids[edge[k] : edge[k + 1]], None
            value[item] = MATCH
            parts = _reached(value[own], least * MATCH * len(item))
            value[item] = value[-1]
            for a, b in parts:
                if _common(item, own[a:b]) < least * len(item):
                    continue
                score, start, end = align(item, own[a:b])
                if score >= least and (best is None or score > best[0]):
                    best = score, a + start, a + end
            if best:
                yield k, i, *best


def _reached(value: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Runs of the places that lie in a run whose values add up to ``least`` or more: no alignment scores more than these."""
    total = np.cumsum(value)
    before = total - value
    ending = total - np.minimum.accumulate(before)
    starting = np.maximum.accumulate(total[::-1])[::-1] - before
    at = np.flatnonzero(ending + starting - value >= least - 1e-9)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist(), strict=True))


def _common(item: np.ndarray, window: np.ndarray) -> int:
    """Words that both have, repeats counted: no alignment matches more."""
    word, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(word, window), len(word) - 1)
    there = np.bincount(at[word[at] == window], minlength=len(word))
    return int(np.minimum(n, there).sum())


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score / (MATCH * words of the item), start and end in the window.

    A cell holds score * UNIT + (NOWHERE - start), so a maximum carries the
    start along; a row needs the row above only.
    """
    n = len(window)
    j = np.arange(n + 1, dtype=np.int64)
    empty = NOWHERE - j
    row, best = empty.copy(), (NOWHERE, 0)
    for word in item:
        cell = empty.copy()
        np.maximum(cell[1:], row[:-1] + np.where(window == word, MATCH, MISMATCH) * UNIT, out=cell[1:])
        np.maximum(cell, row + GAP * UNIT, out=cell)
        cell = np.maximum.accumulate(cell - j * GAP * UNIT) + j * GAP * UNIT
        np.maximum(cell, empty, out=row)
        at = int(row.argmax())
        if row[at] // UNIT > best[0] // UNIT:
            best = row[at], at
    return int(best[0] // UNIT) / (MATCH * len(item)), int(NOWHERE - best[0] % UNIT), best[1]


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, least: float) -> Iterator:
    """Broadcast blocks of the benchmark with their rare words chosen by frequency in ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(quoted(item_col)).alias("item"), F.col(quoted(item_text)).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BROADCAST_BYTES)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        block = Benchmark(sorted(((r["item"], r["text"]) for r in rows), key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1])))
        if not block.items:
            continue
        plain = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], plain=plain) -> Iterator[pa.RecordBatch]:
            block = plain.value
            words, seen = Words(block.vocabulary), np.zeros(len(block.vocabulary), np.int64)
            for b in batches:
                ids, _ = words.of(b.column(0))
                seen += np.bincount(ids[ids >= 0], minlength=len(seen))
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"word": pa.array(some, pa.int64()), "n": pa.array(seen[some])})

        found = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(len(block.vocabulary), np.int64)
        frequency[found.column("word").to_numpy()] = found.column("n").to_numpy()
        block.seed(frequency, least)
        yield spark.sparkContext.broadcast(block)


def contaminations(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document and item that it copies: id, item, ``score`` (0 to 1), ``start_word``, ``end_word``.

    The best alignment counts; words are white-space tokens, lower-cased, less
    everything but letters and digits. Items of fewer than 3 such words match
    nothing; null texts have none. Null ids are carried as they are; repeated
    documents and items each get their rows; an empty table gives none. Other
    columns are left out.
    """
    item_type = benchmark.schema[item_col].dataType
    names = [id_col, *fresh(docs.select(quoted(id_col)), item_col, "score", "start_word", "end_word")]
    schema = schema_of([docs.schema[id_col]], *zip(names[1:], (item_type, DoubleType(), LongType(), LongType()), strict=True))
    item_arrow = to_arrow_type(item_type)
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _blocks(docs, benchmark, text_col, item_col, item_text, min_score):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            words = Words(block.vocabulary)
            for b in batches:
                rows = list(block.matches(b.column(1), words, min_score))
                if rows:
                    k, i, *rest = zip(*rows, strict=True)
                    items = pa.array([block.ids[x] for x in i], item_arrow)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), items, *map(pa.array, rest)], names=names)

        out = out.unionAll(map_arrow(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))), run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the documents that copy an item; same columns, decided in the pass that aligns.

    Null and empty texts copy nothing and stay; repeated rows are judged alike;
    an empty table stays empty, an empty benchmark drops nothing.
    """
    (copy,) = fresh(docs, "_text")
    schema = schema_of(docs.schema.fields)
    out = docs
    for shared in _blocks(docs, benchmark, text_col, item_col, item_text, min_score):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            words = Words(block.vocabulary)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[m[0] for m in block.matches(b.column(b.num_columns - 1), words, min_score)]] = False
                yield b.filter(pa.array(clean)).select(b.schema.names[:-1])

        out = map_arrow(out.withColumn(copy, F.col(quoted(text_col))), run, schema)
    return out
