import random

import numpy as np
import pytest

from regcast.llm import decontam as D

SF = "/root/testdata/sf0.001"
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def brute_align(a, b):
    """Plain Smith-Waterman over words: best score over MATCH * len(a)."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (D.MATCH if x == y else D.MISMATCH), row[j + 1] + D.GAP, new[j] + D.GAP))
        row, best = new, max(best, *new)
    return best / (D.MATCH * len(a))


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, int(rng.integers(1, 12))), rng.integers(-1, 4, int(rng.integers(0, 25)))
        score, start, end = D.align(a, b)
        assert score == brute_align(a.tolist(), b.tolist())
        assert brute_align(a.tolist(), b[start:end].tolist()) == score  # the span holds the whole alignment


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "inserted"] if x < 2 * share / 3 else ["changed"] if x < share else [w]
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3)) if rng.random() < 0.6 else rng.choice(["the", "of", "and"])
    items = [(i, [word() for _ in range(rng.randint(8, 50))]) for i in range(12)]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randint(0, 150))]
        if d % 2:
            text += edited(rng, rng.choice(items)[1], rng.choice([0, 0.1, 0.2])) + [word() for _ in range(30)]
        docs.append((d, " ".join(w.capitalize() + rng.choice(["", "", ",", "."]) for w in text)))
    return docs, [(i, " ".join(w)) for i, w in items]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_aligning_every_pair(spark, seed):
    docs, items = corpus(seed)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminations(spark.createDataFrame(docs, DOC).repartition(4), spark.createDataFrame(items, ITEM)).collect()}
    plain = {d: D.plain_words(t) for d, t in docs}
    want = {(d, i): s for d, _ in docs for i, t in items if (s := brute_align(D.plain_words(t), plain[d])) >= D.MIN_SCORE}
    # every pair with an unedited run of five words is found, with its best score; no other pair is made up
    run = D.SEED_WORDS + D.SEED_WINDOW - 1
    seeded = {(d, i) for d, i in want for t in [D.plain_words(dict(items)[i])] if any(t[a : a + run] == plain[d][b : b + run] for a in range(len(t) - run + 1) for b in range(len(plain[d]) - run + 1))}
    assert set(got) <= set(want) and seeded <= set(got) and all(got[k] == want[k] for k in got)
    assert len(got) > 20 and len(want) - len(got) <= 2


def test_query_equals_aligning_every_pair(spark):
    from regcast.llm.queries import op5_decontamination

    docs = {r["doc_id"]: D.plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: D.plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    number = {}
    ids = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    want = {(d, i): s for d, ws in docs.items() for i, item in items.items() if (s := D.align(ids(item), ids(ws))[0]) >= D.MIN_SCORE}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in op5_decontamination(spark, SF).collect()} == want


def test_edges(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, passage, "x"), (1, None, "y"), (1, "", "y"), (2, passage.upper().replace(" ", ",  "), "z"), (2, passage.replace(" ", " | "), "z"), (3, "filler " * 50_000 + passage, "w"), (4, "filler only", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    bench = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, ""), (10, "two words")], ITEM)
    got = sorted(((r["doc_id"], r["item_id"], r["score"], r["start_word"], r["end_word"]) for r in D.contaminations(df, bench).collect()), key=str)
    assert got == sorted([(None, 7, 1.0, 0, 8)] * 2 + [(2, 7, 1.0, 0, 8)] * 4 + [(3, 7, 1.0, 50_000, 50_008)] * 2, key=str)
    clean = D.drop_contaminated(df, bench)
    assert clean.columns == df.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["1", "1", "4"]
    for empty in (D.contaminations(df.limit(0), bench), D.contaminations(df, bench.limit(0)), D.drop_contaminated(df.limit(0), bench)):
        assert empty.count() == 0
    assert D.drop_contaminated(df, bench.limit(0)).count() == 7


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    docs, items = corpus(3)
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    whole = sorted(map(str, D.contaminations(d, b).collect()))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 600)
    assert sorted(map(str, D.contaminations(d, b).collect())) == whole


@pytest.mark.parametrize("step", [3, 4, 5])
@pytest.mark.parametrize("beside", [False, True])
def test_one_edited_copy_is_found(spark, step, beside):
    """Every step-th word replaced in one document, alone or beside intact copies, which make its own n-grams the frequent ones."""
    item = [f"word{i}" for i in range(40)]
    copy = ["changed" if i % step == step - 1 else w for i, w in enumerate(item)]
    docs = [(1, " ".join(["before", *copy, "behind"]))] + [(k, " ".join(item)) for k in range(2, 6) if beside]
    got = {r["doc_id"]: r["score"] for r in D.contaminations(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, " ".join(item))], ITEM)).collect()}
    assert got == {k: brute_align(item, text.split()) for k, text in docs} and got[1] >= D.MIN_SCORE


@pytest.mark.parametrize("hits", [1, 7, 1 << 20])
def test_no_pair_of_the_wanted_score_is_missed(monkeypatch, hits):
    """All pairs, with edits of any spread (insertions leave no two neighbours, so no n-gram), in chunks of any size."""
    monkeypatch.setattr(D, "HITS", hits)
    rng = random.Random(hits)
    items = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvw", k=rng.randint(3, 25)))) for i in range(15)]
    texts = []
    for _ in range(60):
        words = [w for x in rng.choice(items)[1].split() for w in ([x], [x, "new"], ["new"], [])[rng.choices(range(4), [6, 3, 2, 1])[0]]]
        texts.append(" ".join(rng.choices("abcxyz", k=rng.randint(0, 30)) + words + rng.choices("abcxyz", k=5)))
    texts += ["", None, " ".join(w + " new" for w in items[0][1].split())]
    block, tokens = D.Benchmark(items), D.plain_words
    block.seed(np.bincount([block.vocabulary[w] for t in texts for w in tokens(t) if w in block.vocabulary], minlength=len(block.vocabulary)), D.MIN_SCORE)
    got = {(k, i): s for k, i, s, _, _ in block.matches(D.pa.array(texts, D.pa.string()), D.Words(block.vocabulary), D.MIN_SCORE)}
    want = {(k, i): s for k, t in enumerate(texts) for i, x in items if (s := brute_align(tokens(x), tokens(t))) >= D.MIN_SCORE}
    assert got == want and len(want) > 20 and (len(texts) - 1, 0) in got
