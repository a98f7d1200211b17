"""Source divergence audit: how far each source's terms stray from its language and from the other sources.

Terms are counted inside the tasks. The texts of a batch become one byte
buffer, whose terms are found with array operations. Terms of up to 8 bytes are
packed into one big-endian uint64, terms of up to 16 bytes into two; longer
terms go to buckets of fixed width (32, 64, ... bytes) and are sorted as bytes.
Zero bytes pad a term and occur in none, so packing loses nothing. Packed
terms are put in order by a stable radix sort over 16-bit digits; equal ones
then form runs, and the runs' lengths are the counts. Texts enter in the order
of their (language, source) group, so the same runs also give the documents.

The shuffle carries one row per (language, source, term) and task. A pair of
sources is compared block by block of terms: a task holds one block as a
matrix (source x term) and returns one sum for each pair, never a row per term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from regcast.llm.common import maybe_broadcast, prepare
from regcast.session import materialize

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 8 << 20
#: Runs a task keeps before it hands them to the shuffle.
HELD_RUNS = 2_000_000
#: Cells (source, term) of one block of terms, sources of one tile, and cells of the matrix held at once.
BLOCK_CELLS, TILE, MATRIX = 400_000, 512, 1 << 20

#: Bytes of terms (fixed values): A-Z, a-z and every byte of a code point beyond 127.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[0x41:0x5B] = IN_TERM[0x61:0x7B] = IN_TERM[0x80:] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order by ``words`` (most significant first): one counting pass per 16-bit digit that varies."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        word = word.astype(np.uint64, copy=False)
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def pack(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(width, which terms, keys) per length bucket; ``buffer`` ends with zeros for the widest bucket."""
    words = np.ndarray((len(buffer) - 7,), dtype=">u8", buffer=buffer, strides=(1,))

    def word(at: np.ndarray, used: np.ndarray) -> np.ndarray:
        unused = ((8 - used) * 8).astype(np.uint64)
        return (words[at].astype(np.uint64) >> unused) << unused

    for width in (8, 16):
        mine = np.flatnonzero((lengths <= width) & (lengths > width - 8))
        if mine.size:
            keys = [word(starts[mine], np.minimum(lengths[mine], 8))]
            yield width, mine, keys if width == 8 else [*keys, word(starts[mine] + 8, lengths[mine] - 8)]
    width = 32
    while (lengths > width // 2).any():
        mine = np.flatnonzero((lengths <= width) & (lengths > width // 2))
        if mine.size:
            cells = np.lib.stride_tricks.as_strided(buffer, (len(buffer) - width + 1, width), (1, 1))[starts[mine]]
            cells[np.arange(width) >= lengths[mine][:, None]] = 0
            yield width, mine, [cells.view(f"S{width}").ravel()]
        width *= 2


def ordered(width: int, keys: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
    """Stable order by the terms, then by ``group`` where given."""
    if width <= 16:
        return radix_order(keys if group is None else [*keys, group])
    order = np.arange(len(keys[0])) if group is None else radix_order([group])
    return order[np.argsort(keys[0][order], kind="stable")]


def run_starts(keys: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    new = np.ones(len(group), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def count_slice(text: pa.Array, group: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """(width, (keys, group, occurrences, documents)) of texts whose ``group`` ascends."""
    text = text.cast(pa.large_string())
    cuts = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    if cuts[-1] == cuts[0]:
        return
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[cuts] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    if not starts.size:
        return
    lengths = ends - starts
    doc = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(starts, cuts)))
    pad = 16 if lengths.max() <= 16 else 1 << int(lengths.max() - 1).bit_length()
    buffer = np.concatenate([TO_LOWER[data], np.zeros(pad, dtype=np.uint8)])
    for width, mine, keys in pack(buffer, starts, lengths):
        order = ordered(width, keys)
        keys = [k[order] for k in keys]
        docs = doc[mine[order]]
        groups = group[docs]
        new = run_starts(keys, groups)
        first = np.flatnonzero(new)
        new[1:] |= docs[1:] != docs[:-1]
        yield width, ([k[first] for k in keys], groups[first], np.diff(np.append(first, len(docs))), np.add.reduceat(new.astype(np.int64), first))


def merged(width: int, parts: list[tuple]) -> tuple:
    """Runs of several slices as one: equal (term, group) summed."""
    keys = [np.concatenate([p[0][i] for p in parts]) for i in range(len(parts[0][0]))]
    group, n, docs = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    order = ordered(width, keys, group)
    keys, group = [k[order] for k in keys], group[order]
    first = np.flatnonzero(run_starts(keys, group))
    return [k[first] for k in keys], group[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


def unpack(width: int, keys: list[np.ndarray]) -> pa.Array:
    """Packed terms as strings."""
    if width <= 16:
        cells = np.column_stack(keys).astype(">u8").view(np.uint8).reshape(len(keys[0]), width)
    else:
        cells = np.ascontiguousarray(keys[0]).view(np.uint8).reshape(len(keys[0]), width)
    used = cells != 0
    cuts = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(keys[0]), pa.py_buffer(cuts), pa.py_buffer(cells[used])).cast(pa.string())


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, source, text in; lang, source, term, n, d (occurrences and documents) out."""
    names: dict[tuple[str, str], int] = {}
    held: dict[int, list[tuple]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        for width, parts in held.items():
            keys, group, n, docs = merged(width, parts)
            for a in range(0, len(n), 50_000):
                b = a + 50_000
                cols = [langs.take(pa.array(group[a:b])), sources.take(pa.array(group[a:b])), unpack(width, [k[a:b] for k in keys]), pa.array(n[a:b]), pa.array(docs[a:b])]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "d"])
        held.clear()

    size = 0
    for batch in batches:
        group = np.array([names.setdefault(k, len(names)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], dtype=np.int64)
        order = radix_order([group])
        group, text = group[order], batch.column(2)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)[order].astype(np.int64)) // SLICE_BYTES
        for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(sizes)) + 1):
            if part.size:
                for width, runs in count_slice(text.take(pa.array(order[part])), group[part]):
                    held.setdefault(width, []).append(runs)
                    size += len(runs[1])
        if size > HELD_RUNS:
            for width in held:
                held[width] = [merged(width, held[width])]
            size = sum(len(p[0][1]) for p in held.values())
            if size > HELD_RUNS // 2:
                yield from out()
                size = 0
    yield from out()


def compare_block(table: pa.Table) -> pa.Table:
    """One block of terms and one pair of source tiles: sums of f for each pair of sources.

    Rows without a term are the sources themselves, with the p of a count of
    zero and, in the first block only, the number of the language's terms.
    Terms that neither tile holds add f(p0, q0) each; so every term of the block
    counts as its difference from that, and the first block adds it for all.
    """
    is_base = pc.is_null(table["term"]).to_numpy()
    at, tile, p = (table[c].to_numpy() for c in ("at", "tile", "p"))
    base = np.flatnonzero(is_base)
    base = base[np.argsort(at[base])]
    ids, own, p0, rank = at[base], tile[base], p[base], np.flatnonzero(~is_base)
    n = len(ids)
    code = table["term"].take(pa.array(rank)).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if rank.size else rank
    rank, code = rank[np.argsort(code, kind="stable")], np.sort(code, kind="stable")
    row, value = np.searchsorted(ids, at[rank]), p[rank]
    diff = p0[:, None] - p0[None, :]
    zero = diff * diff // p0[None, :]
    total = zero * table["terms"].to_numpy()[base].max(initial=0)
    n_terms, step = int(code[-1]) + 1 if code.size else 0, max(1, MATRIX // max(n, 1))
    for a in range(0, n_terms, step):
        b = min(a + step, n_terms)
        lo, hi = np.searchsorted(code, [a, b])
        matrix = np.repeat(p0[:, None], b - a, axis=1)
        matrix[row[lo:hi], code[lo:hi] - a] = value[lo:hi]
        for i in range(n):
            d = matrix[i][None, :] - matrix
            total[i] += (d * d // matrix).sum(axis=1) - zero[i] * (b - a)
    # a pair inside one tile is reported by the task of that tile alone
    pair = ~np.eye(n, dtype=bool) & ((own[:, None] != own[None, :]) | (table["ta"][0].as_py() == table["tb"][0].as_py()))
    i, j = np.nonzero(pair)
    source = table["source"].take(pa.array(base)).combine_chunks()
    cols = [pa.repeat(table["lang"][0], len(i)), source.take(pa.array(i)), source.take(pa.array(j)), pa.array(total[i, j])]
    return pa.Table.from_arrays(cols, names=["lang", "source", "item", "value"])


def scaled(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact (decimal digits); 1 where there is no term."""
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), (total + terms).cast("decimal(19,0)"))
    return F.when(terms > 0, 1 + share).otherwise(F.lit(1)).cast("long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for every occurring (lang, source).

    Part ``pair`` compares the source with each other source of its language
    over all kept terms; part ``term`` lists the ``top`` terms that it uses more
    than its language does. Null text, lang and source are read as ''. Every row
    is one document, so repeated rows count as often as they occur; ties in
    value are ranked by item in UTF-8 order. A language without a kept term has
    pairs of value 0 and no terms, a source without another has no pairs, and an
    empty table gives no row. Other columns of ``docs`` are never read.
    """
    prepare(docs.sparkSession)
    own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    slim = docs.select(*own)
    counted = slim.mapInArrow(count_terms, "lang string, source string, term string, n long, d long")
    # dealt once, by (lang, term): the sums and the windows below need no other shuffle
    cells = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    same = W.Window.partitionBy("lang", "term")
    cells = cells.withColumns({"lang_n": F.sum("n").over(same), "docs": F.sum("d").over(same), "first": F.row_number().over(same.orderBy("source")) == 1})
    kept = materialize(cells.filter(F.col("docs") >= min_docs).drop("d", "docs"))

    langs = kept.filter("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, ["lang"], "left").fillna(0)
    number = F.row_number().over(W.Window.partitionBy("lang").orderBy("source")) - 1
    zero = scaled(F.lit(0), F.col("total"), F.col("terms"))
    groups = materialize(groups.withColumns({"at": number.cast("long"), "p": zero}).withColumn("tile", F.floor(F.col("at") / TILE).cast("long")))

    info = maybe_broadcast(groups.drop("p"))
    scored = kept.drop("first").join(info, ["lang", "source"]).withColumns({
        "p": scaled(F.col("n"), F.col("total"), F.col("terms")), "q": scaled(F.col("lang_n"), F.col("lang_total"), F.col("terms")),
    })
    gap = F.col("p") - F.col("q")
    ranked = W.Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    blocks = max(1, -(-kept.count() // BLOCK_CELLS))
    tiles = (groups.agg(F.max("tile")).first()[0] or 0) + 1
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))

    def dealt(rows: DataFrame, block: Column, term: Column, terms: Column) -> DataFrame:
        rows = rows.withColumn("block", block).select("lang", "source", "at", "tile", "p", "block", term.cast("string").alias("term"), terms.alias("terms"), other.alias("other"))
        return rows.select("lang", "block", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "source", "at", "tile", "p", "term", "terms")

    here = F.pmod(F.xxhash64("term"), F.lit(blocks))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    cell_rows = dealt(scored.withColumn("source", F.lit(None).cast("string")), here, F.col("term"), F.lit(0).cast("long"))
    base_rows = dealt(groups, each, F.lit(None), F.when(F.col("block") == 0, F.col("terms")).otherwise(0))
    sums = cell_rows.unionByName(base_rows).groupBy("lang", "block", "ta", "tb").applyInArrow(compare_block, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
