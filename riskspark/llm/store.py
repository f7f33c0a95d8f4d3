"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; only a local master may fall back to one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []
_named: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no earlier run has used."""
    _made.append(f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}")
    return f"{_made[-1]}/{name}"


def clean(spark: SparkSession) -> None:
    """Delete the tables this process has stored; call it when its results are written."""
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _made:
        path = hadoop(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, keeps column pruning and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, by: str | None = None) -> DataFrame:
    """``stored`` with the rows in so many buckets by hash of ``keys``, each sorted by them, in folders by the column ``by``.

    ``df`` should come partitioned that way (``repartition(buckets, *keys)`` or a join of such tables), else
    each task writes a file per bucket. Tables of equal buckets are merge-joined on the keys as they lie, without an exchange. The
    catalog holds a name for the table until ``clean``.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"llm_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(by) if by else writer).saveAsTable(table)
    _named.append(table)
    return spark.table(table)
