"""Extra columns of any name and type, column names with dots, item ids of any type: every operator and stage takes them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from regcast.llm import decontam, langid, mixing, quality, secret_scan, simhash_dedup, token_count

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    struct = F.struct(F.lit(2).alias("x-y"), F.array(F.lit("z")).alias("p.q"))
    return docs.withColumns({"a.b": F.lit(1), "st": struct, "m": F.create_map(F.lit("k`"), F.lit(1.5)), "sc ore": F.lit(None).cast("date")})


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd, k):
    out = P.STAGES[k][1](spark, odd, SF)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() > 0
    row = out.first()
    assert row["st"]["x-y"] == 2 and row["a.b"] == 1 and row["m"] == {"k`": 1.5}


def test_operators(spark, odd):
    odd = odd.withColumnsRenamed({"text": "te.xt", "doc_id": "do c", "source": "so.urce", "lang": "la.ng"})
    good = odd.select("do c").limit(20)
    model = langid.train(odd, "te.xt", "la.ng", "do c")
    assert langid.predict(odd, model, "te.xt").count() == 60
    assert quality.quality(odd, good, "te.xt", "do c").count() == 60
    assert simhash_dedup.near_duplicates(odd, "te.xt", "do c").count() == 60
    assert 0 < simhash_dedup.keep_one(odd, "te.xt", "do c").count() <= 60
    assert token_count.token_counts(odd, "te.xt").count() == 60
    assert mixing.mix(odd, "te.xt", "so.urce", "do c").count() == 60
    assert secret_scan.scan(odd, "te.xt", "so.urce", "do c").count() == 60
    assert secret_scan.redact(odd, "te.xt", "so.urce", "do c").columns == odd.columns


@pytest.mark.parametrize("kind,ids", [("int", [7, None]), ("string", ["", "x"]), ("decimal(9,2)", [1, 2]), ("date", [None, None]), ("smallint", [3, -1])])
def test_item_ids_of_any_type(spark, kind, ids):
    from decimal import Decimal

    item = "one two three four five six seven eight nine ten"
    ids = [Decimal(i) if kind.startswith("decimal") else i for i in ids]
    items = spark.createDataFrame([(ids[0], item), (ids[1], item.replace("ten", "eleven"))], f"score {kind}, text string")
    docs = spark.createDataFrame([(1, f"so {item} it says"), (2, "nothing here")], "doc_id long, text string")
    out = decontam.contaminations(docs, items, item_col="score")
    assert out.columns == ["doc_id", "score", "score_", "start_word", "end_word"]
    assert {(r[0], r[1]) for r in out.collect()} == {(1, i) for i in ids}
    assert decontam.drop_contaminated(docs, items, item_col="score").count() == 1
