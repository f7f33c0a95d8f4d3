"""Peeling of leaves in logarithmic rounds: chains of nodes with two neighbours are settled as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.plans.fixpoint import both_ways, written


def chain_ends(arcs: DataFrame) -> DataFrame:
    """The two ends of the chain each inner node lies on: (src, dst, last, end, end_is_leaf, closed), a row per direction.

    ``arcs`` holds (src, dst, inner, leaf) from every inner node to both neighbours; ``inner`` and
    ``leaf`` describe ``dst``. Walking from ``src`` over ``dst``, ``last`` is the last inner node and ``end``
    the node behind it. Each arc points at its successor and the pointers double, so a
    chain of n nodes takes log2(n) rounds; arcs that no round settles any more form a ring (``closed``).
    """
    onward = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("beyond"))
    state = written(arcs.join(onward, "dst", "left").where("beyond IS NULL OR beyond <> src").select(
        "src", "dst", F.when(F.col("beyond").isNull(), F.col("src")).otherwise(F.col("dst")).alias("last"),
        F.coalesce("beyond", "dst").alias("end"), F.col("beyond").isNull().alias("done"), "leaf"))
    left, before = state.where("NOT done").count(), -1
    while left and left != before:
        ahead = state.select(F.col("src").alias("last"), F.col("dst").alias("end"), F.col("last").alias("last2"),
                             F.col("end").alias("end2"), F.col("done").alias("done2"), F.col("leaf").alias("leaf2"))
        moved = state.where("NOT done").join(ahead, ["last", "end"]).select(
            "src", "dst", F.col("last2").alias("last"), F.col("end2").alias("end"), F.col("done2").alias("done"),
            F.col("leaf2").alias("leaf"))
        state = written(state.where("done").unionByName(moved))
        left, before = state.where("NOT done").count(), left
    return state.select("src", "dst", "last", "end", F.col("leaf").alias("end_is_leaf"), (~F.col("done")).alias("closed"))


def two_core(edges: DataFrame) -> DataFrame:
    """(id): nodes left when nodes with fewer than two neighbours are taken away until none is left.

    ``edges`` are distinct pairs without loops. A round takes away all leaves together with the
    chains that hang on them, and replaces each chain between two branchings by one
    node that stands for it, so the tree-like parts shrink by a constant share a round however long they are. Two
    edges between the same nodes count twice: they are a ring. Rounds are written as tables instead of
    checkpoints, which keep the constraints of all earlier joins and make planning slower every round.
    """
    links = written(both_ways(edges).withColumn("w", F.lit(1)))
    inside = written(links.select(F.col("src").alias("id"), F.col("src").alias("stands")).distinct())
    rings: list[DataFrame] = []
    while True:
        kinds = written(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("near")))
        if kinds.where("degree = 1").isEmpty():
            break
        flags = kinds.select("id", (F.expr("degree = 2 AND near = 2")).alias("inner"), (F.col("degree") == 1).alias("leaf"))
        marked = (links.join(flags.select(F.col("id").alias("src"), F.col("inner").alias("own")).where("own"), "src")
                  .join(flags.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "inner", "leaf"))
        fates = written(chain_ends(marked).groupBy(F.col("src").alias("id")).agg(
            F.min("last").alias("stands"), F.max("end_is_leaf").alias("falls"), F.max("closed").alias("closed")))
        rings.append(fates.where("closed").select(F.col("id").alias("stands")))
        gone = (fates.where("closed OR falls").select("id")
                .unionByName(kinds.where("degree = 1").select("id")))
        shorter = fates.where("NOT closed AND NOT falls").select("id", "stands")
        inside = written(inside.join(shorter.select(F.col("id").alias("stands"), F.col("stands").alias("now")), "stands", "left")
                     .select("id", F.coalesce("now", "stands").alias("stands")))
        for end in ("src", "dst"):
            links = (links.join(gone.withColumnRenamed("id", end), end, "left_anti")
                     .join(shorter.select(F.col("id").alias(end), F.col("stands").alias("now")), end, "left")
                     .withColumn(end, F.coalesce("now", end)).drop("now"))
        links = written(links.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    left = links.select(F.col("src").alias("stands")).distinct()
    for ring in rings:
        left = left.unionByName(ring)
    return inside.join(left, "stands", "left_semi").select("id")
