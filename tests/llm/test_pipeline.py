import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from regcast.llm import decontam, langid, secret_scan, simhash_dedup
from regcast.llm.secret_scan import MARK

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_decide_and_keep_the_columns(spark, docs, tmp_path):
    kept = {}
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = set(ids(now))
        if name == "near_dedup":
            groups = simhash_dedup.near_duplicates(before).collect()
            assert kept[name] == {r["component_id"] for r in groups}
        if name == "decontaminate":
            hit = {r["doc_id"] for r in decontam.contaminations(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert hit and kept[name] == set(ids(before)) - hit
        if name == "secret_scan":
            assert kept[name] == set(ids(before))
            live = {r["doc_id"] for r in secret_scan.scan(before).collect() if r["n_live"]}
            assert live and live == {r["doc_id"] for r in now.filter(F.col("text").contains(MARK)).collect()}
    last = P.STAGES[-1][1](spark, now, SF)
    assert set(ids(last)) <= kept["secret_scan"] and last.filter("taken <= 0").isEmpty()
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, last.collect()))


def test_language_stage_keeps_clean_documents(spark, docs):
    kept = P.language_id(spark, docs, SF)
    assert len(ids(kept)) >= 0.99 * 1000
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "1234 !!", "en", "s", 7)], docs.schema)
    assert ids(P.language_id(spark, docs.unionByName(odd), SF)) == ids(kept)
    assert langid.UNKNOWN == "und"


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_and_odd_tables(spark, docs, k):
    stage = P.STAGES[k][1]
    assert stage(spark, docs.limit(0), SF).count() == 0
    odd = docs.limit(30).withColumns({"size": F.lit(1), "_text": F.lit("x"), "lang_pred": F.lit("y"), "taken": F.lit(1)})
    odd = odd.unionByName(odd.withColumns({c: F.lit(None).cast(odd.schema[c].dataType) for c in odd.columns})).unionByName(odd.limit(3))
    rows = stage(spark, odd, SF)
    assert rows.columns[: len(odd.columns)] == odd.columns and rows.count() > 0
