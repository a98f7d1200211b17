"""Spark session helpers.

The library never creates its own cluster resources: every operator takes the
caller's ``SparkSession``.  ``local_session`` is only for tests and the bench.
Lineage is cut with reliable ``checkpoint()`` into the directory named by
``spark.checkpoint.dir``; a private directory is set only when the cluster did
not name one (local tests).
"""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "regcast") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("REGCAST_DRIVER_MEMORY", "16g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``regcast`` importable on every executor's Python workers.

    Closures and Arrow functions reference this package, so it is zipped
    once per SparkContext and distributed with ``addPyFile`` (the standard
    way code reaches executors; equivalent to ``--py-files``).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        out_dir = tempfile.mkdtemp(prefix="regcast-pyfiles-")
        zpath = os.path.join(out_dir, "regcast.zip")
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _dirs, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
        sc.addPyFile(zpath)
        _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, setting a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if sc.master.split("[")[0] != "local":
            raise ValueError(f"Set {CHECKPOINT_CONF} to a folder that all executors share.")
        # One machine: driver and executors share its temporary folder.
        configured = tempfile.mkdtemp(prefix="regcast-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss).

    Not persisted first: the checkpoint write re-runs only the last stage
    (shuffle outputs are reused), and an uncached plan keeps AQE's
    coalesced partitioning, so small results do not fan out into hundreds
    of tiny partitions downstream."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
