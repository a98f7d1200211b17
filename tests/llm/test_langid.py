import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from regcast.llm import langid as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def predicted(spark):
    from regcast.llm.queries import op4_language_id

    return op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()


def test_held_out_accuracy(predicted):
    held = [r for r in predicted if r["held_out"]]
    assert len(predicted) == 1000 and len(held) > 150
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in predicted)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in predicted)


def test_held_out_labels_and_other_columns_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(df).select("doc_id", "lang_pred", "score").collect())
    assert key(docs) == key(wrong)


def test_backoff_by_hand():
    model = {"words": {"the": 0}, "word_rows": [[-1.0, -3.0]], "grams": {"ab": 0, "b": 1, " th": 2}, "gram_rows": [[-2.0, -1.0], [-5.0, -1.0], [-1.0, -2.0]]}
    s = L.Backoff(model)
    assert s.score("The the").tolist() == [-2.0, -6.0]  # known words
    assert s.score("thx").tolist() == [-1.0, -2.0]  # its only known 3-gram
    assert s.score("xabab").tolist() == [-2.0, -1.0]  # 2-grams, before 1-grams
    assert s.score("qbq").tolist() == [-5.0, -1.0]
    assert s.score("zz").tolist() == [0.0, 0.0]  # nothing known
    assert s.score("12 -- ½") is None and s.score(None) is None and s.score("") is None


def test_full_cache_changes_nothing(monkeypatch):
    model = {"words": {"the": 0}, "word_rows": [[-1.0, -3.0]], "grams": {c: i for i, c in enumerate("abcdef")}, "gram_rows": [[-i - 1.0, -1.0] for i in range(6)]}
    text = " ".join(a + b + c for a in "abcdef" for b in "abcdef" for c in "abcdef") * 3
    want = L.Backoff(model).score(text)
    monkeypatch.setattr(L, "CACHE_ROWS", 20)
    assert L.Backoff(model).score(text) == pytest.approx(want)


def test_edge_rows(spark):
    rows = [(None, "ein haus und der hund", "de"), (1, None, "de"), (1, None, "de"), (2, "", None), (3, "123 ½", "en"), (4, "the house and the dog", "en"), (5, "der hund und die katze", "de"), (6, "the cat and the dog", "en")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    out = L.identify(df)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "held_out", "lang_pred_", "score"]
    got = [(r["text"], r["lang_pred_"]) for r in out.collect()]
    assert len(got) == 8 and all((p == "und") == (t in (None, "", "123 ½")) for t, p in got)
    assert L.identify(df.limit(0)).count() == 0
    assert {r["lang_pred_"] for r in L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def runs_of_letters(text):
    word, out = "", []
    for c in (text or "").lower() + " ":
        if c.isalnum() and not c.isdecimal():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out if any(c.isalpha() for w in out for c in w) else []


def pieces(word, size):
    word = word if size == 1 else f" {word} "
    return [word[i : i + size] for i in range(len(word) - size + 1)]


def brute_model(texts):
    """{size: {item: {lang: log frequency}}} of (text, lang) rows by plain dictionaries; size 0 are whole words."""
    seen = {}
    for text, lang in texts:
        for w in runs_of_letters(text):
            for size in range(5):
                for item in [w] if size == 0 else pieces(w, size):
                    at = seen.setdefault(size, {}).setdefault(item, {})
                    at[lang] = at.get(lang, 0) + 1
    langs, logs = sorted({lang for _, lang in texts}), {}
    for size, items in seen.items():
        items = {i: by for i, by in items.items() if sum(by.values()) >= 2}
        total = {lang: sum(by.get(lang, 0) for by in items.values()) + 0.5 * len(items) for lang in langs}
        logs[size] = {i: {lang: math.log((by.get(lang, 0) + 0.5) / total[lang]) for lang in langs} for i, by in items.items()}
    return langs, logs


def brute_prediction(text, langs, logs):
    words = runs_of_letters(text)
    if not words:
        return None
    total = dict.fromkeys(langs, 0.0)
    for w in words:
        rows = [logs[0][w]] if w in logs[0] else next((r for size in (4, 3, 2, 1) if (r := [logs[size][g] for g in pieces(w, size) if g in logs[size]])), [])
        for lang in langs if rows else ():
            total[lang] += sum(r[lang] for r in rows) / len(rows)
    return total


def test_query_equals_brute_force(spark):
    """Model and predictions of the query, against plain dictionaries over the same documents."""
    from regcast.llm.queries import op4_language_id

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    taught = [(r["text"], r["lang"]) for i, r in docs.items() if not held[i] and r["lang"] is not None and r["text"] is not None]
    assert max(Counter(lang for _, lang in taught).values()) <= L.SAMPLE_DOCS  # so the model learns from all of them
    langs, logs = brute_model(taught)
    rows = op4_language_id(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        total = brute_prediction(docs[r["doc_id"]]["text"], langs, logs)
        assert r["held_out"] == held[r["doc_id"]]
        if total is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best = max(total.values())
        assert total[r["lang_pred"]] == pytest.approx(best, abs=1e-3)  # rows are kept as float32
        assert r["score"] == pytest.approx(1 / sum(math.exp(t - best) for t in total.values()), abs=1e-3)


def test_model_equals_brute_force(spark):
    texts = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien ½", "fr"), ("the dog der", "en"), ("des chats, des chiens", "fr")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = L.train(df, "text", "lang", "doc_id")
    langs, logs = brute_model(texts)
    assert model["languages"] == langs and model["words"].keys() == logs[0].keys()
    assert model["grams"].keys() == {g for size in (1, 2, 3, 4) for g in logs[size]}
    for w, at in model["words"].items():
        assert model["word_rows"][at].tolist() == pytest.approx([logs[0][w][lang] for lang in langs], abs=1e-5)
    for g, at in model["grams"].items():
        size = next(s for s in (1, 2, 3, 4) if g in logs[s] and len(g) == s)
        assert model["gram_rows"][at].tolist() == pytest.approx([logs[size][g][lang] for lang in langs], abs=1e-5)
