import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from regcast.llm import token_count as T

PATH = public_tokenizers.path(T.MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
with open(PATH, "rb") as f:
    ENCODER = T.Encoder(f.read(), {"the": 1})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t\r▁é<s>/0\u3000\u00a0", max_size=60)))
def test_any_text_counts_like_the_library(text):
    assert ENCODER.additive
    assert ENCODER.count(text) == len(SP.encode(text))


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", "\n\n a", " \n ", "a\n", "<s> </s> <unk> <0x0A>", "x" * 5000, "word " * 20_000, "\x00"])
def test_edges(text):
    assert ENCODER.count(text) == len(SP.encode(text))


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "CACHE_ROWS", 3)
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(3000))
    assert T.Encoder(SP.serialized_model_proto(), {}).count(text) == len(SP.encode(text))


def test_query_equals_the_library(spark):
    from regcast.llm.queries import op9_token_count

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op9_token_count(spark, sf).collect()}
    want = {i: (len(t.encode()), n := len(SP.encode(t)), n > 4096) for i, t in texts.items()}
    assert got == want


def test_nulls_repeats_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 1), (3, "a b", 2)], "doc_id long, text string, n_tokens int")
    out = T.token_counts(df)
    assert out.columns == ["doc_id", "n_tokens", "n_bytes", "n_tokens_", "over_limit"]
    assert sorted((r["n_bytes"], r["n_tokens_"]) for r in out.collect()) == [(0, 0), (0, 0), (3, 2)]
    assert T.token_counts(df.limit(0)).count() == 0


def test_frequent_table_is_drawn_from_every_partition(spark):
    left = [(" ".join(f"l{i}x{j}" for j in range(40)),) for i in range(40)]
    right = [("both " + " ".join(f"r{i}x{j}" for j in range(40)),) for i in range(40)]
    df = spark.createDataFrame(left + right, "text string").repartition(4)
    got = T._frequent(df, "text", SP.serialized_model_proto())
    assert len(got) == 3201 and got["both"] == len(SP.encode("both"))
    assert next(iter(got)) == "both"


def test_frequent_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "TABLE_ROWS", 5)
    df = spark.createDataFrame([(f"a b c w{i} v{i}",) for i in range(50)], "text string")
    got = T._frequent(df, "text", SP.serialized_model_proto())
    assert len(got) == 5 and {"a", "b", "c"} <= set(got)
