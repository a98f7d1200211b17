import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regcast.llm import suffix_dedup as S
from regcast.llm.induced import permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    """{index: (n_bytes, n_removed, n_spans, kept)} of byte texts in order."""
    seen, out = {}, []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen[w] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]) if t else b""))
    return out


def corpus(n, seed, letters="ab cé"):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list(letters), int(rng.integers(20, 400)))) for _ in range(12)]
    pool += ["ab" * 150, "x" * 400, "lorem ipsum " * 30]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            p = pool[int(rng.integers(len(pool)))]
            a = int(rng.integers(0, len(p)))
            parts += [p[a : a + int(rng.integers(1, 300))], "".join(rng.choice(list("mnopq "), int(rng.integers(0, 60))))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "CHUNK", 3_000)
    monkeypatch.setattr(S, "SHARD", 20_000 if seed < 3 else 600)  # the small one sends hot anchors to digests
    texts = corpus(150, seed)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.suffix_dedup(df).collect()}
    want = dict(enumerate(brute([t.encode() for t in texts], S.LENGTH)))
    assert got == want
    assert sum(w[1] for w in want.values()) > 1_000


def test_query_equals_brute_force(spark):
    from regcast.llm.queries import op7_suffix_dedup

    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {i: (n, removed, runs, hashlib.sha256(kept).hexdigest()) for (i, _), (n, removed, runs, kept) in zip(rows, brute([t.encode() for _, t in rows], 100), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in op7_suffix_dedup(spark, sf).collect()} == want


def test_periods_inside_a_document(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefghijklmnop"), p)) * max(3, 400 // p) for p in range(1, 126)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.suffix_dedup(spark.createDataFrame(list(enumerate(texts, 1)), SCHEMA)).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], S.LENGTH), 1))


def test_nulls_repeats_and_extra_columns(spark):
    a, b = "one passage that is long enough to be cut, " * 3, "another text, also long enough, that no other has: " * 2
    rows = [(5, a, "x"), (5, a, "y"), (None, a, "z"), (2, None, None), (9, "", "w"), (7, b, "v"), (8, "short", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in S.suffix_dedup(df).collect()), key=str)
    inner = brute([a.encode()], 100)[0][1]
    assert got == sorted([(5, inner), (5, inner), (None, len(a)), (2, 0), (9, 0), (7, brute([b.encode()], 100)[0][1]), (8, 0)], key=str)
    assert S.suffix_dedup(df.filter(F.lit(False))).count() == 0


def test_long_text(spark):
    rng = np.random.default_rng(0)
    long = "".join(rng.choice(list("abcdefgh "), 3_000_000))
    df = spark.createDataFrame([(1, long), (2, long[1_000_000:1_000_500]), (3, "y" * 1_000_000)], SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in S.suffix_dedup(df).drop("kept").collect()}
    assert got == {1: (3_000_000, 0, 0), 2: (500, 500, 1), 3: (1_000_000, 999_999, 1)}


def test_suffix_array_and_prefixes_equal_sorting():
    rng = np.random.default_rng(5)
    cases = [bytes(rng.integers(0, k, n, dtype=np.uint8) * 60) for k in (1, 2, 3, 4) for n in (1, 2, 7, 60, 300)]
    cases += [b"ab" * 200, b"abcabd" * 80 + b"\xff" + b"abcabd" * 40, bytes(range(256)) * 4]
    for text in cases:
        sa = suffix_array(np.frombuffer(text, np.uint8))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == want
        common = permuted_prefixes(np.frombuffer(text, np.uint8), sa)
        for x, y in zip(want, want[1:], strict=False):
            k = int(common[y])
            assert text[x : x + k] == text[y : y + k] and text[x + k : x + k + 1] != text[y + k : y + k + 1]
