"""Exact top-k inner products by sequential reading of sorted lists (no random access).

Candidates and queries are dealt into blocks of bounded size, and every pair of
blocks is one task: no task depends on how many rows the table has, and no pair
of vectors is a row. Inside a task each dimension is a list of the candidates
sorted by their component. A query reads all lists from its better end, down to one
depth after the other. At each depth the components read, and the ends of the unread
parts, bound each candidate's score from both sides; a candidate whose upper bound is
below the k-th best lower bound can't qualify and is never looked at again. A query stops
at the depth where few candidates are left, and their scores are resolved. How deep that
is depends on the vectors: a few large components part the bounds early, components that
are all alike keep most candidates until most of the lists is read. Each task gives k
rows per query, and a limit by rank joins the blocks.

Defined results. Components become floor(scale * x); scores are exact while
they stay below 2^53. A vector that is null, or holds a null or a component
that is not finite, and a row of null id take no part. Every other row is a candidate of
its own for every query but itself, also where ids or vectors repeat, and a query of its own.
Vectors of different lengths do not meet. Ties go to the smaller id. Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.store import stored
from riskspark.session import importable

#: Shares of the lists after which candidates are excluded.
DEPTHS = (0.25, 0.5, 0.75, 0.875)
#: Queries that read the lists together.
TOGETHER = 64


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(row, vec_id, v): whole-number vectors of the rows that take part, numbered."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", x.alias("x"))
    sound = F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return rows.where(sound).select(F.monotonically_increasing_id().alias("row"), "vec_id",
                                    F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


class Lists:
    """The sorted lists of a block of candidates, each list once from either end.

    Queries read a list from its upper end where their component is positive,
    from the lower one where it is negative. What has been read down to a depth
    is the same for all queries with that sign, so sums over read and over
    unread entries are matrix products for many queries at once.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.v = rows[order], ids[order], vectors[order].astype(np.float64)
        self.by = np.argsort(self.v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, self.by, axis=0)
        self.worst = np.concatenate([self.sorted[0], self.sorted[-1]])
        self.read: dict[float, tuple] = {}

    def down_to(self, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What reading ``share`` of every list gives; read when the first query needs it."""
        if share not in self.read:
            self.read[share] = self._read(max(1, int(share * len(self.ids))))
        return self.read[share]

    def _read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries read, as values and (negated) as a mask, and the best value an unread entry can have."""
        n, d = self.v.shape
        seen = np.zeros((n, 2 * d))
        np.put_along_axis(seen[:, :d], self.by[n - depth:], 1.0, axis=0)
        np.put_along_axis(seen[:, d:], self.by[:depth], 1.0, axis=0)
        front = np.concatenate([self.sorted[n - depth], self.sorted[depth - 1]])
        return np.hstack([self.v, self.v]) * seen, 1 - seen, front

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and scores of the best ``k`` of the block, best first; ``own``: the queries' rows."""
        signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
        live = [np.flatnonzero(self.rows != i) for i in own]
        for share in DEPTHS:
            open_ = [i for i, some in enumerate(live) if len(some) > 4 * k]
            if not open_:
                break
            values, unread, front = self.down_to(share)
            asked = signed[open_]
            known = asked @ values.T
            lower, upper = known + (asked * self.worst) @ unread.T, known + (asked * front) @ unread.T
            for j, i in enumerate(open_):
                some = live[i]
                least = np.partition(lower[j, some], len(some) - k)[len(some) - k]
                live[i] = some[upper[j, some] >= least]
        out = []
        for q, some in zip(queries, live):
            scores = self.v[some] @ q
            if len(some) > k:
                enough = scores >= np.partition(scores, len(some) - k)[len(some) - k]
                some, scores = some[enough], scores[enough]
            best = np.lexsort((self.ids[some], -scores))[:k]
            out.append((self.ids[some][best], scores[best]))
        return out


def _search(k: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, rows = group.column("vec_id").to_numpy(), group.column("row").to_numpy()
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        flat = group.column("v").combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 1), np.int64)
        out = [(np.zeros(0, np.int64),) * 4]
        if not asks.all():
            lists = Lists(rows[~asks], ids[~asks], vectors[~asks])
            own, names, queries = rows[asks], ids[asks], vectors[asks].astype(np.float64)
            for i in range(0, len(own), TOGETHER):
                some = slice(i, i + TOGETHER)
                for row, name, (found, scores) in zip(own[some], names[some], lists.top(own[some], queries[some], k)):
                    out.append((np.full(len(found), row), np.full(len(found), name), found, scores.astype(np.int64)))
        row, query, found, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"row": row, "query_id": query, "vec_id": found, "score": score})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block: int = 8_192,
          query_block: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` picks, its ``k`` best other rows."""
    importable(vectors.sparkSession)
    rows = stored(quantised(vectors.select("vec_id", "embedding"), scale), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    place = F.xxhash64("row")
    shape = ["cb", "qb", "dim", "asks", "row", "vec_id", "v"]
    candidates = rows.withColumns({
        "cb": F.pmod(place, F.lit(blocks)), "qb": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")),
        "dim": F.size("v"), "asks": F.lit(False)}).select(*shape)
    queries = rows.where(is_query).withColumns({
        "cb": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")), "qb": F.pmod(place, F.lit(query_blocks)),
        "dim": F.size("v"), "asks": F.lit(True)}).select(*shape)
    found = (candidates.unionByName(queries).groupBy("cb", "qb", "dim")
             .applyInArrow(_search(k), "row bigint, query_id bigint, vec_id bigint, score bigint"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
