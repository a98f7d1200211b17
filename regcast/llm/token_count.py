"""Token counts with a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier one is a compact table (pre-token -> number of tokens) of the most
frequent pre-tokens, broadcast to every worker. Tier two is a bounded cache in
each worker for what the table lacks; a miss is encoded by the library.

A pre-token is a run of spaces with the characters up to the next space, cut
again behind each line feed. No piece of such a vocabulary has a space mark
behind another character or a line feed, so merges never cross these cuts and
the counts add up. ``Counter_`` checks this for the loaded model and encodes
whole texts where it does not hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from regcast.llm.common import fresh, map_arrow, prepare, quoted, schema_of

MODEL = "piece_bpe_32k.model"
#: The frequent table: pre-tokens counted on about SAMPLE_DOCS documents drawn from the whole table by SAMPLE_TASKS tasks. It
#: only saves work; counts do not depend on it.
SAMPLE_DOCS, SAMPLE_TASKS, TABLE_ROWS = 8_000, 8, 32_768
#: Entries of a worker's cache; a full cache starts anew.
CACHE_ROWS = 200_000
SPACES = re.compile(r" +[^ ]*")


def pretokens(text: str) -> tuple[list[str], int]:
    """Keys of a text's pre-tokens, and its line feeds (one token each).

    A key is the pre-token less its first space (the library puts that one
    back); a pre-token at the start of a later line has none, and is marked
    with a line feed.
    """
    lines = f" {text}".replace("▁", " ").split("\n")
    keys: list[str] = []
    for line in lines:
        parts = line.split(" ")
        if parts[0]:
            keys.append("\n" + parts[0])
        if "" in parts[1:]:
            keys += [x[1:] for x in SPACES.findall(line)]
        else:
            keys += parts[1:]
    return keys, len(lines) - 1


class Encoder:
    """One worker's tokenizer, table and cache."""

    def __init__(self, model: bytes, table: dict[str, int]):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.additive = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.sp.encode("  a ", out_type=str)[-1] == "▁"
        self.table, self.cache = table, {}

    def miss(self, key: str) -> int:
        if len(self.cache) >= CACHE_ROWS:
            self.cache.clear()
        n = 1 if key == "" else len(self.sp.encode(key)) - 2 * (key[0] == "\n")
        self.cache[key] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.additive:
            return len(self.sp.encode(text))
        keys, total = pretokens(text)
        table, cache = self.table, self.cache
        for key in keys:
            n = table.get(key)
            if n is None:
                n = cache.get(key)
                if n is None:
                    n = self.miss(key)
            total += n
        return total


def _frequent(docs: DataFrame, text_col: str, model: bytes) -> dict[str, int]:
    """The sample's most frequent pre-tokens and their lengths; of each task's share only TABLE_ROWS rows reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pretokens(t)[0])
        encoder = Encoder(model, {})
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ROWS] if encoder.additive else []
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in top], pa.string()), "seen": pa.array([c for _, c in top], pa.int64()), "n": pa.array([encoder.miss(k) for k, _ in top], pa.int32())})

    rows = docs.select(F.col(quoted(text_col)).alias("text"))
    share = SAMPLE_DOCS / max(1, docs.count())
    drawn = rows.filter(F.rand(42) < share).filter("text != ''").repartition(SAMPLE_TASKS)
    found = sorted(drawn.mapInArrow(tally, "key string, seen long, n int").collect())
    total: Counter = Counter()
    for r in found:
        total[r["key"]] += r["seen"]
    length = {r["key"]: r["n"] for r in found}
    return {k: length[k] for k, _ in total.most_common(TABLE_ROWS)}


def token_counts(docs: DataFrame, text_col: str = "text", model_path: str | None = None, max_tokens: int = 4096) -> DataFrame:
    """``docs`` without its text, plus ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Counts are the library's for the whole text, without added special tokens;
    special strings in a text are ordinary text, the library's default. Null
    texts count as empty (0 bytes, 0 tokens). Rows are counted one by one, so
    repeated rows and an empty table need no care. If ``docs`` has a column
    of a new column's name, the new one gets a ``_`` behind it.
    """
    spark = docs.sparkSession
    prepare(spark)
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    with open(model_path, "rb") as f:  # on the driver; executors get the bytes
        model = f.read()
    shared = spark.sparkContext.broadcast((model, _frequent(docs, text_col, model)))
    rest = [c for c in docs.columns if c != text_col]
    n_bytes, n_tokens, over = fresh(docs, "n_bytes", "n_tokens", "over_limit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for b in batches:
            got = pa.array([encoder.count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            cols = b.columns[:-1] + [got]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], n_tokens])

    kept = docs.select(*map(quoted, rest), F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)).cast("long").alias(n_bytes), F.col(quoted(text_col)))
    schema = schema_of(kept.schema.fields[:-1], (n_tokens, LongType()))
    return map_arrow(kept, count, schema).withColumn(over, F.col(n_tokens) > max_tokens)
