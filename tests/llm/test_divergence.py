import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from regcast.llm import divergence
from regcast.llm.divergence import count_terms, radix_order, source_divergence

SCHEMA = "text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, min_docs=3, top=200):
    docs, occurrences = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(terms(text))
        docs[lang].update(found.keys())
        occurrences[lang, source].update(found)
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in docs.items()}

    def p(counts, lang):
        total = sum(counts[t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept[lang])) for t in kept[lang]}

    shares = {g: p(c, g[0]) for g, c in occurrences.items()}
    out = []
    for lang in kept:
        mine = [g for g in occurrences if g[0] == lang]
        whole = p(sum((occurrences[g] for g in mine), Counter()), lang)
        for g in mine:
            parts = {
                "pair": [(sum((shares[g][t] - shares[h][t]) ** 2 // shares[h][t] for t in kept[lang]), h[1]) for h in mine if h != g],
                "term": [((shares[g][t] - whole[t]) ** 2 // whole[t], t) for t in kept[lang] if occurrences[g][t] and shares[g][t] > whole[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, r + 1) for r, (value, item) in enumerate(found) if part == "pair" or r < top]
    return sorted(out)


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    words = [w for k in (1, 3, 7, 8, 9, 15, 16, 17, 31, 33, 70, 300) for w in ("".join(rng.choice("abcDEZé漢") for _ in range(k)) for _ in range(25))]
    weights = [1 / (i + 1) for i in range(len(words))]
    rng.shuffle(words)
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", "\n", "-", "7", "\x7f", ", "]) for w in rng.choices(words, weights, k=rng.randrange(0, 60)))
        rows.append((text, rng.choice(["en", "de", None, ""]), "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "ß", "c"])))
    return rows


def test_equals_brute_force(spark):
    rows = [*corpus(), (None, "en", "no text"), ("", "xx", None), ("1 2 3", "yy", "s"), ("word", "yy", "t")]
    got = sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()))
    assert got == brute(rows)


def test_blocks_tiles_and_flushes_change_nothing(spark, monkeypatch):
    """Small limits: many blocks of terms, two sources a tile, runs handed over early, tiny slices."""
    rows = corpus(150, seed=8)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 50)
    monkeypatch.setattr(divergence, "TILE", 2)
    assert sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA), top=5).collect())) == brute(rows, top=5)


def test_counting_in_a_task(monkeypatch):
    rows = corpus(200, seed=3)
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in rows]) for i in (1, 2, 0)], names=["lang", "source", "text"])
    want, docs = Counter(), Counter()
    for text, lang, source in rows:
        found = Counter(terms(text))
        want.update({(lang or "", source or "", t): n for t, n in found.items()})
        docs.update((lang or "", source or "", t) for t in found)
    for held, size in ((10**6, 1 << 20), (40, 200)):
        monkeypatch.setattr(divergence, "HELD_RUNS", held)
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        got, got_docs = Counter(), Counter()
        for out in count_terms(batch.slice(a, 30) for a in range(0, 200, 30)):
            for r in out.to_pylist():
                got[r["lang"], r["source"], r["term"]] += r["n"]
                got_docs[r["lang"], r["source"], r["term"]] += r["d"]
        assert got == want and got_docs == docs


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 1000).astype(np.uint64) << np.uint64(61), rng.integers(0, 1 << 63, 1000).astype(np.uint64) % np.uint64(7)
    assert radix_order([a, b]).tolist() == sorted(range(1000), key=lambda i: (a[i], b[i], i))


def test_counts_beyond_a_long_times_the_scale(spark):
    from pyspark.sql import functions as F

    n, total = 2**60 + 12345, 2**62 + 678
    assert spark.range(1).select(divergence.scaled(F.lit(n), F.lit(total), F.lit(9))).first()[0] == 1 + 10**9 * (n + 1) // (total + 9)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("a", "en", "s")] * 3, [("é É", "en", "s"), ("é É", "en", None)] * 2])
def test_edge_rows_and_clashing_names(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", `p` int, `term` string, `a.b` int")
    assert sorted(map(tuple, source_divergence(df).collect())) == brute(rows)
    odd = df.toDF("te.xt", "la ng", "sou.rce", "n", "lang", "source")
    assert sorted(map(tuple, source_divergence(odd, "te.xt", "la ng", "sou.rce").collect())) == brute(rows)
