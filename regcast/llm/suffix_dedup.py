"""Removal of byte strings that also start earlier in the corpus, by suffix arrays over shards.

A full suffix array of the corpus would sort every byte with every other. Here
only text that can hold a repeat is sorted, and equal strings meet in one
shard:

1. Segments. Every ``LENGTH``-byte window has an anchor: the least hash among
   its ``ANCHOR``-byte strings. Equal windows have equal anchors. A segment is a
   run of windows with one anchor; its context is the bytes they cover.
2. Segments are dealt by anchor, once. Segments with equal contexts are equal
   throughout: all but the earliest are repeats, without their text being
   looked at again. A task keeps the earliest of its own equal segments, so a
   passage that a third of the corpus copies arrives as one row a task.
3. Anchors with different contexts (the edges of shared passages, edited
   copies) are undecided. Their contexts, one of each kind, form shards by
   anchor; each shard's suffix array (induced sorting) and permuted common
   prefixes tell its windows that occur earlier.
4. The repeats found in 2 and 3 are merged per document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regcast.llm.common import fresh, prepare
from regcast.llm.induced import permuted_prefixes, suffix_array
from regcast.session import materialize

LENGTH, ANCHOR = 100, 40
#: Bytes hashed at once, bytes of a shard, and bytes of one anchor's contexts beyond which its windows are told apart by digests.
CHUNK, SHARD = 1 << 21, 3 << 20
GAP = b"\xff"  # no byte of UTF-8
LIMIT = np.uint64(2**64 - 1)
SPANS = "doc long, start long, stop long"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A mixed polynomial hash of every ``width``-byte string."""
    factor = 0x9E3779B97F4A7C15
    mask = 2**64 - 1
    symbol = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))
    power, size, part, out, have = factor, 1, symbol[text], None, 0
    while size <= width:
        if width & size:  # append this power of two to what is there
            n = len(text) - have - size + 1
            out = part.copy() if out is None else out[:n] * np.uint64(power) + part[have : have + n]
            have += size
        if 2 * size <= width:
            part = part[:-size] * np.uint64(power) + part[size:]
        power, size = power * power & mask, 2 * size
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def segments(texts: list[bytes], length: int = LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text number, first window, behind the last window, anchor, context hash, anchor occurs twice) of each segment."""
    import xxhash

    size = np.array([len(t) for t in texts], np.int64)
    whole = b"".join(texts)
    begin = np.cumsum(size) - size
    own = np.flatnonzero(size >= length)
    if not len(own):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    h = _hashes(np.frombuffer(whole, np.uint8), width)
    windows = length - width + 1
    anchor = _least(h, windows)
    edge = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(edge, begin[own], 1)
    np.add.at(edge, (begin + size - length + 1)[own], -1)
    valid = np.cumsum(edge)[:-1] > 0
    # valid windows of two texts are never neighbours: the last length - 1 starts of a text are not valid
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])) + 1
    a, b = np.concatenate([[0], cut]), np.append(cut, len(anchor))
    a, b = a[valid[a]], b[valid[a]]
    key = anchor[a]
    # anchors that stand twice within reach of one window or of two neighbours, one run: their segments may repeat a window inside
    masked = np.where(valid, LIMIT - anchor, LIMIT)
    padded = np.concatenate([np.full(windows - 1, LIMIT), masked, np.full(windows - 1, LIMIT)])
    bound = LIMIT - _least(padded, windows)  # greatest anchor of the windows that a place is in
    place = np.flatnonzero(h == bound[: len(h)])
    near = (h[place][1:] == h[place][:-1]) & (np.diff(place) <= windows)
    twice = np.isin(key, np.unique(h[place][1:][near]))
    digest, view = xxhash.xxh3_64_intdigest, memoryview(whole)
    context = np.fromiter((digest(view[i:j]) for i, j in zip(a.tolist(), (b + length - 1).tolist(), strict=True)), np.uint64, len(a))
    text = np.searchsorted(begin, a, side="right") - 1
    return text, a - begin[text], b - begin[text], key.view(np.int64), context.view(np.int64), twice


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    part, size, start = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t or b"")
        size += len(part[-1])
        if size >= CHUNK:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def find_segments(docs: DataFrame, length: int) -> DataFrame:
    """anchor, context, doc, span (start << 32 | windows << 2 | anchor twice << 1 | repeat) of ``docs`` (doc, text as binary).

    Of equal segments in one batch all but the earliest are repeats already;
    their anchor is replaced by a hash of their place, so that they spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).to_numpy()
            found = []
            for at, part in _chunks(b.column(1).to_pylist()):
                text, first, stop, key, context, twice = segments(part, length)
                found.append((key, context, doc[at + text], first << 32 | stop - first << 2 | twice.astype(np.int64) << 1))
            if not found:
                continue
            key, context, own, span = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((span, own, context, key))
            key, context, own, span = key[order], context[order], own[order], span[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1])
            spread = (own * np.int64(-7046029254386353131)) ^ (span * np.int64(-4417276706812531889))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(again, spread, key), context, own, span | again)], names=["anchor", "context", "doc", "span"])

    return docs.mapInArrow(run, "anchor long, context long, doc long, span long")


def repeats_in_shard(doc: np.ndarray, first: np.ndarray, text: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) of the windows of these contexts that occur earlier in one of them."""
    order = np.lexsort((first, doc))
    size = np.array([len(text[i]) for i in order], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    whole = np.frombuffer(GAP.join(text[i] for i in order), np.uint8)
    sa = suffix_array(whole)
    common = permuted_prefixes(whole, sa)
    edge = np.zeros(len(whole) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size - length + 1, -1)
    window = np.cumsum(edge)[:-1] > 0
    sa = sa[window[sa]]
    new = common[sa] < length  # equal windows are neighbours: what sorts between them has their bytes in front
    new[0] = True
    earliest = np.minimum.reduceat(sa, np.flatnonzero(new))[np.cumsum(new) - 1]
    again = np.sort(sa[sa != earliest]).astype(np.int64)
    return _runs(again, begin, doc[order], first[order], length)


def _runs(at: np.ndarray, begin: np.ndarray, doc: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows ``at`` of one context as spans of its document."""
    context = np.searchsorted(begin, at, side="right") - 1
    new = (np.diff(at, prepend=-2) > 1) | (np.diff(context, prepend=-1) > 0)
    last = np.append(new[1:], True)[: len(at)]
    k = context[new]
    return doc[k], first[k] + at[new] - begin[k], first[k] + at[last] - begin[k] + length


def _digests(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats among windows of contexts whose anchor has too many for one shard, told by 128-bit digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for doc, first, text in zip(*(b.column(c).to_pylist() for c in ("doc", "first", "text")), strict=True):
                n, view = len(text) - length + 1, memoryview(text)
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(np.full(n, doc)), pa.array(first + np.arange(n))], names=["a", "b", "doc", "start"])

    windows = contexts.mapInArrow(run, "a long, b long, doc long, start long")
    earliest = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("e"), F.count("*").alias("n")).filter("n > 1")
    return windows.join(earliest, ["a", "b"]).filter(F.struct("doc", "start") != F.col("e")).select("doc", "start", (F.col("start") + length).alias("stop"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, start, stop (bytes) of spans that cover the repeated windows of ``docs`` (doc: unique long, text: binary)."""
    found = find_segments(docs, length).repartition("anchor")
    same = Window.partitionBy("anchor", "context").orderBy("doc", "span")
    group = Window.partitionBy("anchor")
    found = found.withColumns({"nth": F.row_number().over(same), "least": F.min("context").over(group), "most": F.max("context").over(group)})
    again = (F.col("nth") > 1) | (F.col("span").bitwiseAND(1) == 1)
    undecided = ~again & ((F.col("least") != F.col("most")) | (F.col("span").bitwiseAND(2) == 2))
    first, size = F.shiftright("span", 32), F.shiftright("span", 2).bitwiseAND((1 << 30) - 1)
    found = materialize(found.filter(again | undecided).select("anchor", "doc", first.alias("start"), (first + size + length - 1).alias("stop"), again.alias("again")))
    sure = found.filter("again").select("doc", "start", "stop")
    open_ = found.filter("not again")

    heavy = open_.groupBy("anchor").agg(F.sum(F.col("stop") - F.col("start")).alias("bytes"))
    total, hot = heavy.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    shards = max(1, -(-total // SHARD))
    parts = open_.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    if hot > SHARD:
        parts = parts.join(heavy.filter(F.col("bytes") > SHARD).select("anchor", F.lit(-1).cast("long").alias("alone")), "anchor", "left").withColumn("shard", F.coalesce("alone", "shard"))
    wanted = parts.groupBy("doc").agg(F.collect_list(F.struct("shard", "start", "stop")).alias("parts"))
    cut = F.transform("parts", lambda p: F.struct(p["shard"].alias("shard"), p["start"].alias("first"), F.substring("text", p["start"].cast("int") + 1, (p["stop"] - p["start"]).cast("int")).alias("text")))
    contexts = docs.join(wanted, "doc").select("doc", F.explode(cut).alias("c")).select("c.shard", "doc", "c.first", "c.text")

    def shard(t: pa.Table) -> pa.Table:
        doc, start, stop = repeats_in_shard(t.column("doc").to_numpy(), t.column("first").to_numpy(), t.column("text").to_pylist(), length)
        return pa.table({"doc": doc, "start": start, "stop": stop})

    if hot > SHARD:
        contexts = materialize(contexts)
        sure = sure.unionAll(_digests(contexts.filter("shard < 0"), length))
        contexts = contexts.filter("shard >= 0")
    return sure.unionAll(contexts.groupBy("shard").applyInArrow(shard, SPANS))


def cut_out(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the bytes that stay."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    a = start[new]
    b = reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else reach
    kept = b"".join(text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
    return int((b - a).sum()), len(a), kept


def suffix_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes).

    A byte goes if a ``length``-byte string that covers it also starts earlier:
    in a document with a smaller id, or earlier in the same one. Null texts are
    empty. Rows that repeat id and text are one document, and each gets that
    document's result. Different texts under one id, and null ids (which come
    last), are documents in the order of their text's digest. Texts under
    ``length`` bytes stay whole. Other columns are left out. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    plain = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    odd = not plain or not rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").isEmpty()
    if odd:
        from regcast.operators.rowindex import with_row_index

        rows = rows.withColumn("sha", F.sha2("text", 256))
        numbers = with_row_index(rows.select(F.col("id").isNull().alias("late"), "id", "sha").distinct(), ["late", "id", "sha"], "doc").df
        numbers = numbers.select(F.col("id").alias("nid"), F.col("sha").alias("nsha"), "doc")
        rows = rows.join(numbers, (F.col("sha") == F.col("nsha")) & F.col("id").eqNullSafe(F.col("nid"))).select("id", "doc", "text", "sha")
        texts = rows.groupBy("doc").agg(F.first("text").alias("text"))
    else:
        rows = rows.withColumn("doc", F.col("id").cast("long"))
        texts = rows.select("doc", "text")
    spans = repeats(texts, length).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.select("id", "doc", "text").join(spans, "doc", "left").select("id", "text", F.col("spans.start").alias("start"), F.col("spans.stop").alias("stop"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text, start, stop in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                got.append((len(text), *(cut_out(text, np.array(start), np.array(stop)) if start else (0, 0, text))))
            n, removed, runs, kept = zip(*got, strict=True) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, *new])

    new = fresh(docs.select(id_col), "n_bytes", "n_removed", "n_spans", "kept")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{new[0]}` long, `{new[1]}` long, `{new[2]}` long, `{new[3]}` binary")

