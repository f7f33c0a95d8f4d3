"""Sharding by extendible hashing.

Every row has a 60-bit hash. The directory starts at the empty prefix; a
bucket above the byte limit splits on its next bit, the others stay. A shard is
the shortest prefix whose rows fit the limit, or which holds a single row (one
that is larger than the limit can't be split). Bits are looked at eight at a
time: one round sums the bytes of the still oversized buckets by eight more
bits, finds the depth of each of these cells, and leaves only cells that are
still too large to the next round. The work is partial sums and joins on
evenly spread hashes; the number of rounds is log2(bytes / limit) / 8.

Defined results. Null text has 0 bytes; a null id is hashed like an empty one.
Equal rows (same id and text) are numbered ``copy`` = 1, 2, ... and hashed
with that number, so that a hot id splits like any other. Only ``doc_id`` and
``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.store import stored

BITS, STEP = 60, 8


def _prefix(depth: Column | int) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})") if isinstance(depth, int) else F.expr(f"shiftright(h, {BITS} - depth)")


def hashed_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, copy, n_bytes, h), one row per row of ``documents``."""
    rows = (documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                             F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
            .groupBy("doc_id", "n_bytes", "digest").agg(F.count(F.lit(1)).alias("n"))
            .select("doc_id", "n_bytes", "digest", F.explode(F.expr("sequence(1L, n)")).alias("copy")))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"))
    return rows.select("doc_id", "copy", "n_bytes", F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long").alias("h"))


def assign_shards(documents: DataFrame, shard_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, copy, n_bytes, shard, depth, shard_bytes, shard_rows), one row per row of ``documents``.

    ``shard`` is the hash prefix as a string of ``depth`` bits.
    """
    open_rows = stored(hashed_rows(documents), "hashed")
    done: list[DataFrame] = []
    depth = 0
    while True:
        deepest = min(depth + STEP, BITS)
        cells = open_rows.groupBy(_prefix(deepest).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("r"))
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deepest))).alias("depth")
        buckets = (cells.select("cell", "b", "r", levels)
                   .select("cell", "depth", F.expr(f"shiftright(cell, {deepest} - depth)").alias("bucket"), "b", "r"))
        sums = buckets.groupBy("depth", "bucket").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= shard_bytes) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        leaves = stored(buckets.select("cell", "depth", "bucket").join(sums.where(fits), ["depth", "bucket"])
                        .groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("leaf"))
                        .select("cell", "leaf.*"), "leaves")
        keyed = open_rows.withColumn("cell", _prefix(deepest))
        done.append(keyed.join(leaves, "cell").select(
            "doc_id", "copy", "n_bytes", "depth", "shard_bytes", "shard_rows",
            F.expr(f"substring(lpad(bin(h), {BITS}, '0'), 1, depth)").alias("shard")))
        left = keyed.join(leaves.select("cell"), "cell", "left_anti").drop("cell")
        if deepest == BITS or left.isEmpty():
            break
        open_rows, depth = stored(left, "open"), deepest
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "copy", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
