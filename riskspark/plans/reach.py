"""How many nodes lie within each distance of every node, for all nodes at once.

Each node carries a row of bytes: a bit per source that reaches it, or the registers of a
distinct-count sketch. A round merges the rows of neighbours. An edge belongs to the block of its end of
lower degree, so a row travels once per block that holds one of its edges and comes back once per such block,
not once per edge; only rows that changed in the last round travel. Nodes are put into blocks by ranges of
their ids, and a block holds a bounded number of bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.plans.fixpoint import both_ways, cut

#: Registers of a sketch, which are the bytes of a row at most, and bytes of the rows of a block.
SKETCH_BITS = 14
ROW_BYTES, BLOCK_BYTES = 1 << SKETCH_BITS, 32 << 20
#: Rows merged at once.
STEP = 256
RANK_BITS = 64 - SKETCH_BITS

STATE = "home int, idx long, hash long, blocks array<int>, row binary, seen double, total double, changed boolean"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def estimate(registers: np.ndarray) -> np.ndarray:
    """Distinct counts of rows of registers, by Ertl's improved estimator: no switch between small and large counts."""
    m, top = registers.shape[1], RANK_BITS + 1
    at = registers.astype(np.int64) + (np.arange(len(registers)) * (top + 1))[:, None]
    counts = np.bincount(at.ravel(), minlength=len(registers) * (top + 1)).reshape(-1, top + 1).astype(float)

    def tau(x: float) -> float:
        if x in (0.0, 1.0):
            return 0.0
        y, z = 1.0, 1 - x
        while True:
            x, old, y = math.sqrt(x), z, y * 0.5
            z -= (1 - x) ** 2 * y
            if z == old:
                return z / 3

    def sigma(x: float) -> float:
        if x == 1.0:
            return math.inf
        y, z = 1.0, x
        while True:
            x, old = x * x, z
            z += x * y
            y += y
            if z == old:
                return z

    out = []
    for c in counts:
        z = m * tau(1 - c[top] / m)
        for k in range(top - 1, 0, -1):
            z = 0.5 * (z + c[k])
        out.append(m * m / (2 * math.log(2)) / (z + m * sigma(c[0] / m)))
    return np.array(out)


def _size(rows: np.ndarray, sketch: bool) -> np.ndarray:
    if not len(rows):
        return np.zeros(0)
    return estimate(rows) if sketch else np.bitwise_count(rows).sum(axis=1).astype(float)


def _own(nodes: pa.Table, first: int, width: int, sketch: bool) -> pa.Table:
    """Every node with the row of itself alone; sources before ``first`` or behind the row's bits have none."""
    rows = np.zeros((len(nodes), width), np.uint8)
    if sketch:
        hashes = nodes["hash"].to_numpy().astype(np.int64).view(np.uint64)
        _, bits = np.frexp((hashes >> np.uint64(SKETCH_BITS)).astype(float))
        rows[np.arange(len(nodes)), (hashes % np.uint64(width)).astype(np.int64)] = RANK_BITS + 1 - bits
    else:
        at = nodes["idx"].to_numpy() - first
        mine = np.flatnonzero((at >= 0) & (at < 8 * width))
        rows[mine, at[mine] // 8] = 1 << (at[mine] % 8)
    size = _size(rows, sketch)
    return (nodes.append_column("row", _binary(rows)).append_column("seen", pa.array(size))
            .append_column("total", pa.array(np.zeros(len(nodes)))).append_column("changed", pa.array(size > 0)))


def _gather(sent: pa.Table, links: pa.Table, width: int, homes: int, sketch: bool) -> pa.Table:
    """Of one block: what its edges bring to each of their ends."""
    merge = np.maximum if sketch else np.bitwise_or
    idx, rows = sent["idx"].to_numpy(), _matrix(sent["row"], width)
    order = np.argsort(idx)
    ends, out = [links["low"].to_numpy(), links["high"].to_numpy()], {}
    for src, dst in (ends, ends[::-1]) if len(idx) else ():
        place = order[np.minimum(np.searchsorted(idx, src, sorter=order), len(idx) - 1)]
        have = idx[place] == src
        place, dst = place[have], dst[have]
        by = np.argsort(dst, kind="stable")
        place, dst = place[by], dst[by]
        starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else []
        for a, b in zip(starts, [*starts[1:], len(dst)]):
            into = out.setdefault(int(dst[a]), np.zeros(width, np.uint8))
            for i in range(a, b, STEP):
                merge(into, merge.reduce(rows[place[i:min(i + STEP, b)]], axis=0), out=into)
    return pa.table({"home": pa.array([i % homes for i in out], pa.int32()), "idx": pa.array(list(out), pa.int64()),
                     "row": pa.array([r.tobytes() for r in out.values()], pa.binary())})


def _settle(state: pa.Table, got: pa.Table, width: int, sketch: bool, depth: int) -> pa.Table:
    """Of one home: nodes with what has come in, and the distances of the nodes that are new to them."""
    merge = np.maximum if sketch else np.bitwise_or
    rows, place = _matrix(state["row"], width).copy(), {int(i): k for k, i in enumerate(state["idx"].to_numpy())}
    old = rows.copy()
    for i, row in zip(got["idx"].to_pylist(), got["row"].to_pylist()):
        merge(rows[place[i]], np.frombuffer(row, np.uint8), out=rows[place[i]])
    seen, total = state["seen"].to_numpy().copy(), state["total"].to_numpy().copy()
    changed = (rows != old).any(axis=1)
    at = np.flatnonzero(changed)
    now = np.maximum(_size(rows[at], sketch), seen[at])
    total[at] += depth * (now - seen[at])
    seen[at] = now
    for name, values in (("row", _binary(rows)), ("seen", pa.array(seen)), ("total", pa.array(total)), ("changed", pa.array(changed))):
        state = state.set_column(state.column_names.index(name), name, values)
    return state


def numbered(nodes: DataFrame, blocks: int) -> DataFrame:
    """(id, block, idx): nodes in ``blocks`` ranges of their ids, numbered from 0 in the order of the ids."""
    blocks = max(1, blocks)
    placed = cut(nodes.repartitionByRange(blocks, "id").select("id", F.spark_partition_id().alias("block")))
    sizes, first = {r["block"]: r["n"] for r in placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}, 0
    offset = F.lit(0).cast("bigint")
    for block in sorted(sizes):
        offset = F.when(F.col("block") >= block, first).otherwise(offset)
        first += sizes[block]
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
    return cut(placed.select("id", "block", (place + offset).cast("bigint").alias("idx")))


def distance_sums(edges: DataFrame, nodes: DataFrame, sketch: bool, block_bytes: int = BLOCK_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(id, r, total): how many other nodes each node reaches, and the sum of their distances.

    Exact, with sources taken ``8 * row_bytes`` at a time, so that a row has no more than ``row_bytes``; with ``sketch``
    estimated from one row of registers per node. ``edges`` (src, dst): simple, undirected.
    """
    n = nodes.count()
    width = ROW_BYTES if sketch else max(1, min(row_bytes, -(-n // 8)))
    blocks = max(1, -(-n * width // block_bytes))
    placed = numbered(nodes, blocks)
    degree = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    known = placed.join(degree, "id")
    ends = [known.select(F.col("id").alias(e), F.struct("degree", "idx", "block").alias(f"{e}_at")) for e in ("src", "dst")]
    both = edges.join(ends[0], "src").join(ends[1], "dst").select(
        F.least("src_at", "dst_at").alias("low"), F.greatest("src_at", "dst_at").alias("high"))
    links = cut(both.select("low.block", F.col("low.idx").alias("low"), F.col("high.idx").alias("high")))
    used = (links.select("block", F.explode(F.array("low", "high")).alias("idx")).distinct()
            .groupBy("idx").agg(F.collect_list("block").alias("blocks")))
    base = cut(placed.join(used, "idx", "left").select(
        (F.col("idx") % blocks).cast("int").alias("home"), "idx", F.xxhash64(F.col("id").cast("string")).alias("hash"),
        F.coalesce("blocks", F.array().cast("array<int>")).alias("blocks")))
    def own(start: int):
        def run(nodes: pa.Table) -> pa.Table:
            return _own(nodes, start, width, sketch)
        return run

    def gather(sent: pa.Table, links: pa.Table) -> pa.Table:
        return _gather(sent, links, width, blocks, sketch)

    def settle(depth: int):
        def run(state: pa.Table, got: pa.Table) -> pa.Table:
            return _settle(state, got, width, sketch, depth)
        return run

    parts = None
    for start in [0] if sketch else range(0, max(n, 1), 8 * width):
        state = cut(base.groupBy("home").applyInArrow(own(start), STATE))
        depth = 0
        while not state.where("changed").isEmpty():
            depth += 1
            sent = state.where("changed").select(F.explode("blocks").alias("block"), "idx", "row")
            got = sent.groupBy("block").cogroup(links.groupBy("block")).applyInArrow(gather, "home int, idx long, row binary")
            state = cut(state.groupBy("home").cogroup(got.groupBy("home")).applyInArrow(settle(depth), STATE))
        part = cut(state.select("idx", "seen", "total"))
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("idx").agg((F.sum("seen") - 1).alias("r"), F.sum("total").alias("total"))
    return placed.select("id", "idx").join(sums, "idx").select("id", "r", "total")
