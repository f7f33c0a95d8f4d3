"""Iterations over DataFrames: reliable checkpoints, convergence counts, components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir


_passing = threading.local()


def _note(path: str) -> None:
    if getattr(_passing, "paths", None) is not None:
        _passing.paths.append(path)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and drop the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if getattr(_passing, "paths", None) is not None:
        _note(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def _stored(df: DataFrame, by: Sequence[str]) -> str:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """Write the rows as Parquet under the shared checkpoint folder, partitioned by
    the given columns, and read them back: later branches prune columns and partitions."""
    path = _stored(df, by)
    _note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written in the block, in this thread, are deleted when it ends."""
    outer, _passing.paths = getattr(_passing, "paths", None), []
    try:
        yield
    finally:
        paths, _passing.paths = _passing.paths, outer
        for path in paths:
            _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], *by: str) -> DataFrame:
    """``written`` rows of ``make()``, without the tables that ``make`` itself wrote on the way."""
    with passing(spark):
        df = make()
        schema, path = df.schema, _stored(df, by)
    _note(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def held(df: DataFrame, *by: str) -> Iterator[DataFrame]:
    """``written`` rows for as long as the block lasts."""
    path = _stored(df, by)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _delete(df.sparkSession, path)


def side_by_side(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """``work`` of every item, each in a thread of its own, so that the small jobs of one fill the cores others leave idle."""
    with ThreadPoolExecutor(max_workers=max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str) -> DataFrame:
    """Repeat ``step`` until its boolean column ``changed`` is false everywhere.

    ``step`` receives the state without that column and must settle for every
    input: there is no limit of rounds. Every round ends in a checkpoint, so a lost
    executor costs one round at most.
    """
    while True:
        state = cut(step(state))
        settled = state.where(F.col(changed)).isEmpty()
        state = state.drop(changed)
        if settled:
            return state


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each undirected edge in both directions."""
    return edges.select(src, dst).unionByName(
        edges.select(F.col(dst).alias(src), F.col(src).alias(dst)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id as the component label.

    A round takes the smallest label among neighbours and then the label of
    that label, so long chains shrink fast.
    """
    links = cut(both_ways(edges.where("src <> dst")).distinct())
    labels = links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select(
        "id", F.least("id", "m").alias("component"))

    def step(state: DataFrame) -> DataFrame:
        around = (links.join(state.select(F.col("id").alias("dst"), F.col("component").alias("theirs")), "dst")
                  .groupBy(F.col("src").alias("id")).agg(F.min("theirs").alias("theirs")))
        nearer = state.join(around, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "theirs").alias("component"))
        up = state.select(F.col("id").alias("component"), F.col("component").alias("above"))
        return nearer.join(up, "component").select(
            "id", F.least("component", "above").alias("component"),
            (F.least("component", "above") != F.col("old")).alias("changed"))

    return iterate(labels, step, "changed")
