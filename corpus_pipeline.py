"""Corpus pipeline: language ID, near-dedup, decontamination, secrets, mixing.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir),
works on all its predecessor kept, and all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet into the shared
folder of ``spark.checkpoint.dir`` and reads it again for the next one.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regcast.llm.common import fresh, prepare, quoted, table  # noqa: E402
from regcast.llm.decontam import drop_contaminated  # noqa: E402
from regcast.llm.langid import UNKNOWN, held_out, predict, train  # noqa: E402
from regcast.llm.mixing import mix  # noqa: E402
from regcast.llm.secret_scan import redact  # noqa: E402
from regcast.llm.simhash_dedup import keep_one  # noqa: E402
from regcast.session import ensure_checkpoint_dir  # noqa: E402

#: Least posterior of the best language; documents below it are rejected.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model can name: text without letters, null text and undecided text go.

    The model learns from the stage's own documents that are not held out.
    If no language can be learned (no labelled document), nothing is rejected
    but text that has no letter: there is no verdict to act on.
    """
    prepare(spark)
    model = train(docs.filter(~held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    if not model["languages"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score = fresh(docs, "lang_pred", "score")
    named = predict(docs, model)
    return named.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits): the one with the smallest id.

    Null, empty and wordless texts are one group; rows that repeat an id are told
    apart by their whole row; an empty table stays empty; every column is kept.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item; null and empty texts copy none, repeated rows are judged alike, every column is kept."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live credentials in their texts are masked, copied examples stay.

    Null and empty texts stay as they are, repeated rows are masked alike, every column is kept.
    """
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken words.

    Null and empty texts have size 0 and are not taken; null is a source like any
    other; repeated rows share the cut; a new column whose name is there gets a ``_``.
    """
    mixed = mix(docs)
    return mixed.filter(F.col(mixed.columns[-1]) > 0)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]
ORACLE_SQL = None  # the first three stages have no SQL form; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table ``documents`` of ``sf_dir``; none if it is empty."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
