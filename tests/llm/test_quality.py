import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regcast.llm import quality as Q

SF = "/root/testdata/sf0.001"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def words_of(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    t = text or ""
    w = words_of(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = {}
    for x in windows:
        counts[x] = counts.get(x, 0) + 1
    hit = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        dups += line in seen and bool(words_of(line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def brute_ratio(texts, good):
    """{id: llr} by plain dictionaries, every document's own n-grams left out of both distributions."""

    def buckets(text):
        h = [zlib.crc32(w.encode()) for w in words_of(text or "")]
        pairs = [(((a * 0x9E3779B1 + b + 1) % 2**64) * 0xC2B2AE3D27D4EB4F % 2**64 >> 40) % Q.BUCKETS for a, b in zip(h, h[1:], strict=False)]
        return [x % Q.BUCKETS for x in h] + pairs

    raw, target = [0] * Q.BUCKETS, [0] * Q.BUCKETS
    for i, t in texts.items():
        for b in buckets(t):
            raw[b] += 1
            target[b] += i in good
    n, m = sum(raw), sum(target)
    prior, out = Q.PRIOR_SHARE * m, {}
    for i, t in texts.items():
        own = buckets(t)
        score = []
        for b in own:
            here = own.count(b)
            p = (raw[b] - here + 1) / (n - len(own) + Q.BUCKETS)
            left, total = (target[b] - here, m - len(own)) if i in good else (target[b], m)
            score.append(math.log((left + prior * p) / (total + prior) / p))
        out[i] = sum(score) / len(score) if score else 0.0
    return out


def test_query_equals_brute_force(spark):
    from regcast.llm.queries import op3_quality

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1}
    want = brute_ratio(texts, good)
    own = sorted(want[i] for i in good if not brute(texts[i])[-1])
    cut = math.floor(own[math.floor(Q.LOSE * len(own))] / Q.STEP) * Q.STEP
    rows = op3_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in BASE) == brute(texts[r["doc_id"]])
        assert r["llr"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        if abs(r["llr"] - cut) > 1e-9:
            assert r["kept"] == (not r["base_failed"] and r["llr"] >= cut)


def labelled(spark, share):
    """Shares kept at sf0.1 of the good documents whose label the operator did not see, and of the bad ones."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    seen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(100)) < share
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = Q.quality(docs, labels.filter((F.col("quality") == 1) & seen).select("doc_id"))
    rows = out.join(labels, "doc_id").withColumn("seen", seen).filter("n_words >= 40").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and (share == 100 or not r["seen"])]
    return np.mean(good), np.mean([r["kept"] for r in rows if r["quality"] == 0])


@pytest.mark.parametrize("share", [10, 50, 100])
def test_verdict_does_not_hang_on_the_number_of_labels(spark, share):
    good, bad = labelled(spark, share)
    assert good > 0.9 and bad < 0.2, (good, bad)


def test_threshold_of(spark):
    scores = spark.createDataFrame([(i / 100,) for i in range(100)], "s double")
    assert Q.threshold_of(scores, 0.05) == pytest.approx(0.05, abs=Q.STEP)
    assert Q.threshold_of(scores, 0.0) == pytest.approx(0.0, abs=Q.STEP)
    assert Q.threshold_of(scores.limit(0)) == float("-inf")


@pytest.mark.parametrize("text", ["a b c d e f g h " * 5, "a " * 100, "x y\nx y\n\n\n \n x y", "one two three four five six seven eight nine", "é ü # | é x", "a b c d e f g h i a b c d e f g h j " + " ".join(map(str, range(50)))])
def test_measures(text):
    data = text.encode()
    assert Q.measures(data, data.split()) == brute(text)[:5]


def test_edge_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 30_000, 3), (3, " ".join(map(str, range(50_000))), 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    good = spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")
    out = Q.quality(df, good)
    assert out.columns[:2] == ["doc_id", "kept"] and out.columns[-1] == "kept_"
    got = {(r["doc_id"], r["n_words"], r["base_failed"], r["kept_"]) for r in out.collect()}
    assert out.count() == 5 and got == {(None, 0, True, False), (1, 0, True, False), (2, 30_000, True, False), (3, 50_000, False, True)}
    assert Q.quality(df.limit(0), good).count() == 0
    assert {r["llr"] for r in Q.quality(df, good.limit(0)).collect()} == {0.0}
