"""Model artifacts (IO4): a fitted pipeline as JSON metadata + tables.

``serialize_artifact``/``deserialize_artifact`` give a JSON document (the
model state is feature-sized: coefficients, trees, hidden layers, encoder
categories).  ``save_artifact``/``load_artifact`` write it through Spark
to any Hadoop path (one small text file) plus Parquet tables for the
row-sized parts (a knn model's training rows, large ordinal vocabularies),
so artifacts live on the cluster's shared storage.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.encoders import Preprocessor, Scaler
from ..plans.config import FeatureSelection, ModelSpec, PipelineConfig
from ..plans.workflows import ARTIFACT_VERSION, FittedPipeline

_KIND = "regcast-regression-pipeline"


def _plan_rows(plan):
    if plan is None:
        return None
    if isinstance(plan, DataFrame):
        from ..functions.profile import plan_steps

        return [list(r) for r in plan_steps(plan)]
    return [list(r) for r in plan]


def _jsonable(v):
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, np.ndarray):
        return v.tolist()
    raise TypeError(f"not serialisable: {type(v)}")


def to_document(fitted: FittedPipeline, tables: dict | None = None) -> dict:
    """JSON document; row-sized parts go to ``tables`` (name → DataFrame)
    when given (the on-storage writer), else they are refused."""
    cfg = fitted.config
    from ..operators.neighbors import KNNModel

    if isinstance(fitted.model, KNNModel):
        if tables is None:
            raise ValueError("A knn model keeps its training rows; save it with save_artifact.")
        tables["knn_train"] = fitted.model.train
        model_doc = {"kind": "knn", "features": fitted.model.features, "n_neighbors": fitted.model.n_neighbors,
                     "weights": fitted.model.weights, "table": "knn_train"}
    else:
        model_doc = fitted.model.to_dict()
    pre = fitted.preprocessor
    if pre.ordinal_tables:
        if tables is None:
            raise ValueError("Large ordinal vocabularies are saved as tables; use save_artifact.")
        for col, t in pre.ordinal_tables.items():
            tables[f"ordinal_{col}"] = t
    return {
        "kind": _KIND,
        "version": fitted.version,
        "features": list(fitted.features),
        "target": fitted.target,
        "feature_families": fitted.families,
        "model_label": fitted.label,
        "config": {
            "order_by": list(cfg.order_by),
            "plan": _plan_rows(cfg.plan),
            "model": {"key": cfg.model.key, "params": cfg.model.params},
            "target_processing": cfg.target_processing,
            "feature_selection": [cfg.feature_selection.method, cfg.feature_selection.count] if cfg.feature_selection else None,
            "lookback": cfg.lookback,
        },
        "preprocessor": json.loads(fitted.preprocessor.to_json(allow_tables=tables is not None)),
        "ordinal_tables": sorted(pre.ordinal_tables),
        "encoded_names": list(fitted.encoded_names),
        "selected": list(fitted.selected),
        "scaler": [fitted.scaler.kind, fitted.scaler.shift, fitted.scaler.scale],
        "history": fitted.history,
        "model": model_doc,
    }


def from_document(doc: dict, tables: dict | None = None) -> FittedPipeline:
    if not isinstance(doc, dict) or doc.get("kind") != _KIND:
        raise ValueError("The uploaded file is not a model artifact.")
    if doc.get("version") != ARTIFACT_VERSION:
        raise ValueError(f"Unsupported artifact version {doc.get('version')}; expected {ARTIFACT_VERSION}.")
    from ..operators.models import model_from_dict

    c = doc["config"]
    fs = FeatureSelection(*c["feature_selection"]) if c["feature_selection"] else None
    cfg = PipelineConfig(
        tuple(doc["features"]),
        doc["target"],
        tuple(c["order_by"]),
        [tuple(r) for r in c["plan"]] if c["plan"] is not None else None,
        ModelSpec(c["model"]["key"], c["model"]["params"]),
        c["target_processing"],
        fs,
        c["lookback"],
    )
    kind, shift, scale = doc["scaler"]
    pre = Preprocessor.from_json(json.dumps(doc["preprocessor"]))
    for col in doc.get("ordinal_tables", []):
        if tables is None:
            raise ValueError("This artifact keeps tables; load it with load_artifact.")
        pre.ordinal_tables[col] = tables[f"ordinal_{col}"]
    if doc["model"].get("kind") == "knn":
        if tables is None:
            raise ValueError("This artifact keeps tables; load it with load_artifact.")
        from ..operators.neighbors import KNNModel

        md = doc["model"]
        model = KNNModel(md["features"], tables[md["table"]], int(md["n_neighbors"]), md["weights"])
    else:
        model = model_from_dict(doc["model"])
    return FittedPipeline(
        config=cfg,
        families=doc["feature_families"],
        preprocessor=pre,
        encoded_names=doc["encoded_names"],
        selected=doc["selected"],
        scaler=Scaler(kind, shift, scale),
        model=model,
        history=doc["history"],
        label=doc["model_label"],
        version=doc["version"],
    )


def serialize_artifact(fitted: FittedPipeline) -> str:
    return json.dumps(to_document(fitted), default=_jsonable)


def deserialize_artifact(data: str | bytes) -> FittedPipeline:
    try:
        doc = json.loads(data)
    except (ValueError, TypeError) as e:
        raise ValueError("The uploaded file is not a model artifact.") from e
    return from_document(doc)


def save_artifact(fitted: FittedPipeline, path: str, spark: SparkSession | None = None) -> None:
    """One small JSON text file plus a Parquet table per row-sized part,
    written by Spark to any Hadoop path (shared storage on a cluster)."""
    spark = spark or SparkSession.getActiveSession()
    base = path.rstrip("/")
    tables: dict = {}
    text = json.dumps(to_document(fitted, tables), default=_jsonable)
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{base}/{name}")
    spark.createDataFrame([(text,)], "doc string").coalesce(1).write.mode("overwrite").text(f"{base}/artifact")


def load_artifact(spark: SparkSession, path: str) -> FittedPipeline:
    base = path.rstrip("/")
    rows = spark.read.text(f"{base}/artifact").collect()
    if len(rows) != 1:
        raise ValueError("The uploaded file is not a model artifact.")
    try:
        doc = json.loads(rows[0][0])
    except ValueError as e:
        raise ValueError("The uploaded file is not a model artifact.") from e
    names = list(doc.get("ordinal_tables", []))
    tables = {f"ordinal_{c}": spark.read.parquet(f"{base}/ordinal_{c}") for c in names}
    if isinstance(doc.get("model"), dict) and doc["model"].get("kind") == "knn":
        tables[doc["model"]["table"]] = spark.read.parquet(f"{base}/{doc['model']['table']}")
    return from_document(doc, tables)
