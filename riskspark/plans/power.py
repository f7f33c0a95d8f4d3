"""Products of (I + adjacency) with a vector, whose values stay packed per home of nodes.

A node lives in a home; an edge belongs to the home of its end of lower degree, so homes are even
(see ``plans.spread``). A round has two steps: a home sends each other home the values of those of its nodes that are
upper ends there, in one row per pair of homes, and gets back what their edges add up for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.plans.fixpoint import both_ways, cut

HOME_EDGES = 1 << 18
#: Rows between homes: to whom, from whom, and values; a home's row to itself has ``own`` set and the values before the last product.
SENT = "to int, `from` int, own boolean, x binary, p binary"


def _numbers(value: pa.Scalar, kind=np.float64) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _rows(rows: list[tuple]) -> pa.Table:
    to, sender, own, x, p = zip(*rows) if rows else [()] * 5
    return pa.table({"to": pa.array(to, pa.int32()), "from": pa.array(sender, pa.int32()), "own": pa.array(own, pa.bool_()),
                     "x": pa.array([v.tobytes() for v in x], pa.binary()), "p": pa.array([v.tobytes() for v in p], pa.binary())})


NONE = np.zeros(0)


def _lay_out(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """Of one home: its nodes in order, its edges as places among these and among their upper ends, and per home the upper ends that live there."""
    home, ids = nodes["home"][0].as_py(), nodes["id"].combine_chunks()
    ids = ids.take(pc.sort_indices(ids))
    far = pa.table({"id": edges["high"], "home": edges["there"]}).group_by(["home", "id"]).aggregate([]).sort_by([("home", "ascending"), ("id", "ascending")])
    homes, starts = np.unique(far["home"].to_numpy(), return_index=True)
    far_ids = far["id"].combine_chunks()
    ends = [pc.index_in(edges[e], value_set=among).to_numpy().astype(np.int32).tobytes() if len(edges) else b""
            for e, among in (("low", ids), ("high", far_ids))]
    return pa.table({"home": pa.array([home], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     "low": pa.array(ends[:1], pa.binary()), "high": pa.array(ends[1:], pa.binary()),
                     "far": pa.ListArray.from_arrays(pa.array([0, len(far_ids)], pa.int32()), far_ids),
                     "homes": pa.array([homes.tolist()], pa.list_(pa.int32())),
                     "starts": pa.array([[*starts.tolist(), len(far_ids)]], pa.list_(pa.int32()))})


def _routes(nodes: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one home: for each home that asks, the places of the nodes it asks for."""
    ids = nodes["ids"].combine_chunks().values
    at = [pc.index_in(part.values, value_set=ids).to_numpy().astype(np.int32).tobytes() for part in asked["ids"]]
    return pa.table({"home": nodes["home"].take([0] * len(asked)), "by": asked["by"], "at": pa.array(at, pa.binary())})


def _add(got: pa.Table, links: pa.Table) -> pa.Table:
    """Of one home: the sums its edges bring to its nodes, and to their upper ends."""
    values = {(r["from"].as_py(), r["own"].as_py()): _numbers(r["x"]) for r in _each(got)}
    home = got["to"][0].as_py()
    x = values[home, True]
    homes, starts = links["homes"][0].as_py(), links["starts"][0].as_py()
    low, high = _numbers(links["low"][0], np.int32), _numbers(links["high"][0], np.int32)
    far = np.concatenate([NONE, *[values[h, False] for h in homes]])
    back = np.bincount(high, x[low], starts[-1])
    return _rows([(home, home, True, x + np.bincount(low, far[high], len(x)), x),
                  *[(h, home, False, back[a:b], NONE) for h, a, b in zip(homes, starts, starts[1:])]])


def _pass_on(got: pa.Table, routes: pa.Table) -> pa.Table:
    """Of one home: its nodes with what has come back for them, sent to the homes that ask."""
    at = {r["by"].as_py(): _numbers(r["at"], np.int32) for r in _each(routes)}
    home, x, p = got["to"][0].as_py(), None, None
    for r in _each(got.sort_by([("own", "descending"), ("from", "ascending")])):
        if r["own"].as_py():
            x, p = _numbers(r["x"]).copy(), _numbers(r["p"])
        else:
            x[at[r["from"].as_py()]] += _numbers(r["x"])
    return _rows([(home, home, True, x, p), *[(by, home, False, x[places], NONE) for by, places in at.items()]])


def _each(table: pa.Table):
    return ({name: table[name][i] for name in table.column_names} for i in range(len(table)))


class Power:
    """``edges`` (src, dst): simple, undirected; every node of ``nodes`` has a value, isolated ones keep theirs."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, home_edges: int = HOME_EDGES):
        self.homes = max(1, -(-max(edges.count(), nodes.count()) // home_edges))
        self.kind = kind = nodes.schema["id"].dataType.simpleString()
        degree = cut(both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")))
        ends = [degree.select(F.col("id").alias(e), F.struct("degree", F.col("id").alias("end")).alias(f"{e}_at")) for e in ("src", "dst")]
        directed = edges.join(ends[0], "src").join(ends[1], "dst").select(
            F.least("src_at", "dst_at")["end"].alias("low"), F.greatest("src_at", "dst_at")["end"].alias("high"))
        lives = nodes.select(self._home("id").alias("home"), "id")
        self.layout = cut(lives.groupBy("home").cogroup(
            directed.select(self._home("low").alias("home"), "low", "high", self._home("high").alias("there")).groupBy("home")).applyInArrow(
            _lay_out, f"home int, ids array<{kind}>, low binary, high binary, far array<{kind}>, homes array<int>, starts array<int>"))
        self.links = self.layout.select("home", "low", "high", "homes", "starts")
        asked = self.layout.select(F.col("home").alias("by"), "far", "starts", F.posexplode("homes").alias("i", "home")).select(
            "by", "home", F.expr("slice(far, starts[i] + 1, starts[i + 1] - starts[i])").alias("ids"))
        self.routes = cut(self.layout.select("home", "ids").groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(
            _routes, "home int, by int, at binary"))

    def _home(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.homes)).cast("int")

    def _passed_on(self, sent: DataFrame) -> DataFrame:
        return sent.groupBy("to").cogroup(self.routes.groupBy("home")).applyInArrow(_pass_on, SENT)

    def start(self, value: float) -> DataFrame:
        """The state in which every node has this value."""
        def own(batches):
            for batch in batches:
                for r in _each(pa.Table.from_batches([batch])):
                    x = np.full(r["n"].as_py(), value)
                    yield from _rows([(r["home"].as_py(), r["home"].as_py(), True, x, x)]).to_batches()
        return self._passed_on(self.layout.select("home", F.size("ids").alias("n")).mapInArrow(own, SENT))

    def product(self, state: DataFrame) -> DataFrame:
        return self._passed_on(state.groupBy("to").cogroup(self.links.groupBy("home")).applyInArrow(_add, SENT))

    def scaled(self, state: DataFrame, by: float) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = [_numbers(v) * by for v in batch["x"]]
                yield batch.set_column(3, "x", pa.array([v.tobytes() for v in x], pa.binary()))
        return state.mapInArrow(run, SENT)

    def total(self, state: DataFrame, of) -> float:
        """The sum over all nodes of ``of(value, value before the last product)``."""
        def run(batches):
            for batch in batches:
                yield pa.record_batch({"s": pa.array([float(of(_numbers(x), _numbers(p)).sum()) for x, p in zip(batch["x"], batch["p"])], pa.float64())})
        return state.where("own").select("x", "p").mapInArrow(run, "s double").agg(F.sum("s")).first()[0]

    def values(self, state: DataFrame) -> DataFrame:
        """(id, x) of all nodes."""
        def run(batches):
            for batch in batches:
                for r in _each(pa.Table.from_batches([batch])):
                    yield pa.record_batch({"id": r["ids"].values, "x": pa.array(_numbers(r["x"]))})
        own = state.where("own").select(F.col("to").alias("home"), "x")
        return self.layout.select("home", "ids").join(own, "home").select("ids", "x").mapInArrow(run, f"id {self.kind}, x double")
