"""Rows of numbers per node, moved along the edges of a graph and added up where they arrive.

An edge belongs to the block of its end of lower degree. A row travels once to each block that holds an edge of its
node, and what a block adds up for a node comes back once, so a node of any degree costs a row per block and not one
per edge. No node is the lower end of more than sqrt(2 * edges) edges, so blocks are even; their number follows from
the edges and from the width of a row, so that the rows of a block stay within a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.plans.fixpoint import both_ways, cut

#: Bytes of the rows a block may meet at one side of its edges, and edges of a block.
BLOCK_BYTES, BLOCK_EDGES = 32 << 20, 1 << 18
#: Edges whose rows are added up at once.
STEP = 4096


def matrix(column: pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def binary(rows: np.ndarray, empty: np.ndarray | None = None) -> pa.Array:
    """Rows as bytes; null where ``empty``."""
    if empty is None:
        return pa.array([r.tobytes() for r in rows], pa.binary())
    return pa.array([None if e else r.tobytes() for r, e in zip(rows, empty)], pa.binary())


def add_up(into: np.ndarray, rows: np.ndarray, place: np.ndarray, dst: np.ndarray) -> None:
    """``into[dst[i]] += rows[place[i]]`` for all i."""
    by = np.argsort(dst, kind="stable")
    place, dst = place[by], dst[by]
    for a in range(0, len(dst), STEP):
        at = dst[a:a + STEP]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        into[at[starts]] += np.add.reduceat(rows[place[a:a + STEP]], starts, axis=0)


def arrived(got: pa.Table, state: pa.Table, width: int) -> np.ndarray:
    """Per row of the state the sum of the rows that came in for its node."""
    out = np.zeros((len(state), width))
    if len(got):
        place = pc.index_in(got["id"], value_set=state["id"].combine_chunks()).to_numpy()
        add_up(out, matrix(got["row"], width), np.arange(len(got)), place)
    return out


def _pack(links: pa.Table) -> pa.Table:
    """Of one block: its nodes, and its edges as places among them."""
    ids = pc.unique(pa.chunked_array(links["low"].chunks + links["high"].chunks))
    ends = [pc.index_in(links[e], value_set=ids).to_numpy().astype(np.int32).tobytes() for e in ("low", "high")]
    return pa.table({"block": links["block"][:1].cast(pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     "low": pa.array(ends[:1], pa.binary()), "high": pa.array(ends[1:], pa.binary())})


def _gather(sent: pa.Table, links: pa.Table, width: int) -> tuple[pa.Array, np.ndarray]:
    """Of one block: the nodes its edges reach from what was sent, and the sums they bring."""
    if not len(links) or not len(sent):
        return sent["id"].combine_chunks()[:0], np.zeros((0, width))
    ids = links["ids"].combine_chunks().values
    out, reached = np.zeros((len(ids), width)), np.zeros(len(ids), bool)
    have = np.full(len(ids), -1)
    at = pc.fill_null(pc.index_in(sent["id"], value_set=ids), -1).to_numpy()
    have[at[at >= 0]] = np.flatnonzero(at >= 0)
    rows = matrix(sent["row"], width)
    ends = [np.frombuffer(links[e][0].as_py(), np.int32) for e in ("low", "high")]
    for src, dst in (ends, ends[::-1]):
        place = have[src]
        known = place >= 0
        add_up(out, rows, place[known], dst[known])
        reached[dst[known]] = True
    return ids.take(pa.array(np.flatnonzero(reached))), out[reached]


class Spread:
    """A graph laid out for moving rows of ``width`` numbers.

    ``edges`` (src, dst): simple, undirected. ``places``: (home, id, blocks) per node, isolated ones, too.
    States have these columns, and in ``row`` the bytes of what a node sends, null for nothing.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, width: int, block_bytes: int = BLOCK_BYTES):
        per_block = max(1, min(BLOCK_EDGES, block_bytes // (8 * width)))
        self.width, self.homes = width, max(1, -(-max(edges.count(), nodes.count()) // per_block))
        self.id = f"id {nodes.schema['id'].dataType.simpleString()}"
        degree = cut(both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")))
        ends = [degree.select(F.col("id").alias(e), F.struct("degree", F.col("id").alias("end")).alias(f"{e}_at")) for e in ("src", "dst")]
        directed = edges.join(ends[0], "src").join(ends[1], "dst").select(
            F.least("src_at", "dst_at")["end"].alias("low"), F.greatest("src_at", "dst_at")["end"].alias("high"))
        kind = self.id.split(" ", 1)[1]
        self.links = cut(directed.select(self._home("low").alias("block"), "low", "high").groupBy("block").applyInArrow(
            _pack, f"block int, ids array<{kind}>, low binary, high binary"))
        used = (self.links.select("block", F.explode("ids").alias("id")).groupBy("id")
                .agg(F.collect_list("block").alias("blocks")))
        self.places = cut(nodes.join(used, "id", "left").select(
            self._home("id").alias("home"), "id", F.coalesce("blocks", F.array().cast("array<int>")).alias("blocks")))

    def _home(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.homes)).cast("int")

    def start(self, places: DataFrame, own: Callable[[pa.Table], pa.Table], columns: str) -> DataFrame:
        """The first state: ``own`` adds ``columns`` to the nodes of a home."""
        return places.groupBy("home").applyInArrow(own, f"home int, {self.id}, blocks array<int>, {columns}")

    def moved(self, state: DataFrame, settle: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
        """The state after every node has got the sums of its neighbours' rows, which ``settle`` is given per home.

        The state is read twice, so it should be written.
        """
        width, schema = self.width, state.schema

        def gather(sent: pa.Table, links: pa.Table) -> pa.Table:
            ids, rows = _gather(sent, links, width)
            return pa.table({"id": ids, "row": binary(rows)})

        def bring(state: pa.Table, got: pa.Table) -> pa.Table:
            return settle(state, arrived(got, state, width))

        sent = state.where("row IS NOT NULL").select(F.explode("blocks").alias("block"), "id", "row")
        got = (sent.groupBy("block").cogroup(self.links.groupBy("block")).applyInArrow(gather, f"{self.id}, row binary")
               .select(self._home("id").alias("home"), "id", "row"))
        return state.groupBy("home").cogroup(got.groupBy("home")).applyInArrow(bring, schema)


def with_columns(table: pa.Table, **columns: pa.Array) -> pa.Table:
    """The table with columns replaced or added at its end."""
    for name, values in columns.items():
        at = table.schema.get_field_index(name)
        table = table.append_column(name, values) if at < 0 else table.set_column(at, name, values)
    return table
