"""Session settings every job of this package relies on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffle files go when the query that made them ends, not when the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever their working folder."""
    root = str(Path(__file__).resolve().parents[1])
    given = spark.sparkContext.environment
    have = [p for p in given.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        given["PYTHONPATH"] = os.pathsep.join([root, *have])


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; broadcast stays governed by Spark's size check."""
    importable(spark)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # The cluster default is far too many tasks for one machine; a cluster keeps its own value.
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))
    return spark


def build_session(app: str = "riskspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskspark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder
