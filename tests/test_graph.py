import random
import threading
from collections import defaultdict, deque
from datetime import datetime
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import graph
from riskspark.plans import chains, power, reach, spread
from riskspark.plans.fixpoint import cut, written


def make(spark, edges, extra=()):
    nodes = sorted({x for e in edges for x in e} | set(extra))
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return (spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "id long"), nodes, near)


def random_edges(n=30, m=60, seed=5):
    r = random.Random(seed)
    hub = [(0, i) for i in range(1, n) if i % 3 == 0]
    return hub + [tuple(sorted(r.sample(range(n), 2))) for _ in range(m)] + [(4, 4)]


@pytest.fixture(scope="module")
def g(spark):
    return make(spark, random_edges(), extra=[99])


def bfs(near, s):
    dist, sigma, order, q = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
    while q:
        v = q.popleft()
        order.append(v)
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                q.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
    return dist, sigma, order


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_betweenness_exact(g):
    edges, nodes, names, near = g
    want = defaultdict(float)
    for s in names:
        dist, sigma, order = bfs(near, s)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist.get(v, -1) == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    n = len(names)
    got = values(graph.betweenness(edges, nodes, None), "betweenness_centrality")
    for v in names:
        assert got[v] == pytest.approx(want[v] / ((n - 1) * (n - 2)))


def test_betweenness_over_many_blocks_and_slices_of_pivots(g, monkeypatch):
    """A state has a row per node, whatever the number of pivots, and the pivots that do not fit a row come later."""
    edges, nodes, names, near = g
    whole, written = values(graph.betweenness(edges, nodes, None), "betweenness_centrality"), []
    monkeypatch.setattr(graph, "PIVOTS", 16)
    monkeypatch.setattr(graph, "Spread", partial(spread.Spread, block_bytes=8 * 16 * 20))
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df := cut(df)) or df)
    assert values(graph.betweenness(edges, nodes, None), "betweenness_centrality") == pytest.approx(whole)
    states = [df for df in written if "paths" in df.columns]
    assert {df.count() for df in states} == {len(names)} and states[0].select("home").distinct().count() > 1


def test_path_graph_middle_carries_paths(spark):
    edges, nodes, _, _ = make(spark, [(1, 2), (2, 3), (3, 4)])
    got = values(graph.betweenness(edges, nodes, None), "betweenness_centrality")
    assert got[1] == 0 and got[2] == pytest.approx(2 / 3)


def test_closeness_exact_and_sketch(g):
    edges, nodes, names, near = g
    exact = values(graph.closeness(edges, nodes, "exact"), "closeness_centrality")
    sketch = values(graph.closeness(edges, nodes, "sketch"), "closeness_centrality")
    n = len(names)
    for v in names:
        dist, _, _ = bfs(near, v)
        r, total = len(dist) - 1, sum(dist.values())
        assert exact[v] == pytest.approx(r / total * r / (n - 1) if total else 0.0)
        assert sketch[v] == pytest.approx(exact[v], rel=0.03, abs=1e-9)


@pytest.mark.parametrize("sketch", [False, True])
def test_distance_sums_over_many_blocks_and_slices(spark, sketch):
    edges, nodes, names, near = make(spark, random_edges(90, 60, 3), extra=[500, 501])
    rows = reach.distance_sums(graph.simple_edges(edges), nodes, sketch, block_bytes=400 if not sketch else 200_000, row_bytes=4).collect()
    assert sorted(r["id"] for r in rows) == names
    for row in rows:
        dist, _, _ = bfs(near, row["id"])
        assert row["r"] == pytest.approx(len(dist) - 1, rel=0.04 if sketch else 0, abs=1e-2 if sketch else 0)
        assert row["total"] == pytest.approx(sum(dist.values()), rel=0.04 if sketch else 0, abs=1e-2 if sketch else 0)


def test_rows_travel_per_block_and_not_per_edge(spark, monkeypatch):
    """A star with many leaves: its centre is sent once to each block, the leaves never leave theirs."""
    edges, nodes, _, _ = make(spark, [(0, i) for i in range(1, 600)])
    sent = []
    monkeypatch.setattr(reach, "cut", lambda df: sent.append(df := cut(df)) or df)
    reach.distance_sums(edges, nodes, False, block_bytes=12_000)
    base = next(df for df in sent if df.columns[-1] == "blocks")
    blocks = base.select(F.size("blocks").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert blocks[1] > 1 and blocks[0] == 599 + blocks[1]


def test_register_estimates_are_close():
    rng = np.random.default_rng(1)
    for n in (10, 1000, 50_000, 400_000):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        registers = np.zeros(reach.ROW_BYTES, np.uint8)
        _, bits = np.frexp((hashes >> np.uint64(reach.SKETCH_BITS)).astype(float))
        np.maximum.at(registers, (hashes % np.uint64(reach.ROW_BYTES)).astype(int), (reach.RANK_BITS + 1 - bits).astype(np.uint8))
        assert reach.estimate(registers[None, :])[0] == pytest.approx(n, rel=0.025)


def core_by_hand(near):
    left, core, k = {v: set(w) for v, w in near.items() if w}, {}, 0
    while left:
        v = min(left, key=lambda u: len(left[u]))
        k = max(k, len(left[v]))
        core[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    return core


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(chains, "written", lambda df: rounds.append(1) or written(df))
    assert chains.two_core(spark.range(1999).selectExpr("id AS src", "id + 1 AS dst")).isEmpty() and len(rounds) < 20


def test_core_numbers_of_rings_loops_and_trees(spark):
    ring = [(5000 + i, 5000 + (i + 1) % 20) for i in range(20)]
    bridge = [(6000, 6001), (6001, 6002), (6000, 6002), (6002, 6003), (6003, 6004), (6004, 6005), (6005, 6006), (6006, 6007), (6005, 6007)]
    loop = [(7000, 7001), (7001, 7002), (7002, 7000), (7000, 7010), (7010, 7011), (7011, 7012), (7012, 7000), (7011, 7020), (7020, 7021)]
    tree = [(8000 + i, 8000 + i // 2) for i in range(2, 12)]
    edges, _, _, near = make(spark, ring + bridge + loop + tree + random_edges(40, 30, 1))
    assert values(graph.core_numbers(edges), "core_number") == core_by_hand(near)


def test_core_numbers_by_peeling(g):
    edges, _, names, near = g
    left, core, k = {v: set(near[v]) for v in names if near[v]}, {}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    assert values(graph.core_numbers(edges), "core_number") == core


def test_triangles_by_counting(g):
    edges, _, names, near = g
    got = {r["id"]: r for r in graph.triangles(edges).collect()}
    for v in got:
        t = sum(1 for a in near[v] for b in near[v] if a < b and b in near[a])
        d = len(near[v])
        assert got[v]["triangles"] == t
        assert got[v]["clustering_coefficient"] == pytest.approx(2 * t / (d * (d - 1)) if d > 1 else 0)


def test_eigenvector(g):
    edges, nodes, names, near = g
    a = np.array([[1.0 if w in near[v] else 0.0 for w in names] for v in names])
    vals, vecs = np.linalg.eigh(a)
    want = np.abs(vecs[:, -1])
    got = values(graph.eigenvector(edges, nodes), "eigenvector_centrality")
    assert np.allclose([got[v] for v in names], want, atol=1e-3)


def test_eigenvector_over_many_homes(spark, monkeypatch):
    """Text ids, a node without edges, edges between homes; what is written per round is a row per pair of homes, not per edge."""
    edges, nodes, names, near = make(spark, random_edges(24, 200, 2), extra=[99])
    written = []
    monkeypatch.setattr(graph, "Power", partial(power.Power, home_edges=60))
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df := cut(df)) or df)
    text = [F.format_string("n%02d", c) for c in ("src", "dst", "id")]
    got = values(graph.eigenvector(edges.select(text[0].alias("src"), text[1].alias("dst")), nodes.select(text[2].alias("id"))), "eigenvector_centrality")
    want = np.abs(np.linalg.eigh(np.array([[1.0 if w in near[v] else 0.0 for w in names] for v in names]))[1][:, -1])
    assert np.allclose([got[f"n{v:02d}"] for v in names], want, atol=1e-3)
    states = [df for df in written if "own" in df.columns]
    homes = states[0].where("own").count()
    assert homes > 1 and all(df.count() <= homes * (homes + 1) for df in states)


def test_communities_of_two_cliques(spark):
    clique = lambda s: [(a, b) for a in range(s, s + 6) for b in range(a + 1, s + 6)]
    edges, nodes, _, _ = make(spark, clique(0) + clique(10) + [(0, 10)])
    weighted = edges.withColumn("weight", F.lit(1.0))
    by_label, by_gain = graph.label_propagation(edges, nodes), graph.modularity_communities(edges, nodes)
    for found in (by_label, by_gain):
        c = values(found, "community")
        assert len({c[i] for i in range(6)}) == 1 and len({c[i] for i in range(10, 16)}) == 1
    q = graph.modularity(weighted, by_gain)
    assert q >= graph.modularity(weighted, by_label) - 1e-9
    assert q == pytest.approx(2 * (15 / 31 - (31 / 62) ** 2))


def test_modularity_not_below_label_propagation(g):
    edges, nodes, _, _ = g
    weighted = graph.simple_edges(edges).withColumn("weight", F.lit(1.0))
    assert graph.modularity(weighted, graph.modularity_communities(edges, nodes)) >= graph.modularity(
        weighted, graph.label_propagation(edges, nodes)) - 1e-9


def test_loops_of_node_features_run_side_by_side(spark, monkeypatch):
    """One after the other, their many small rounds had left most cores idle."""
    met = threading.Barrier(2, timeout=60)

    def meeting(measure):
        def wrapped(*args):
            met.wait()
            return measure(*args)
        return wrapped

    monkeypatch.setattr(graph, "betweenness", meeting(graph.betweenness))
    monkeypatch.setattr(graph, "eigenvector", meeting(graph.eigenvector))
    rows = [(1, 2), (2, 3), (1, 3), (3, 4)]
    tx = spark.createDataFrame([(a, b, 1.0, datetime(2024, 1, 1), "pix") for a, b in rows],
                               "customer_id long, beneficiary_id long, amount double, timestamp timestamp_ntz, product_type string")
    customers = spark.range(1, 6).withColumnRenamed("id", "customer_id")
    got = {r["customer_id"]: r for r in graph.node_features(customers, tx).collect()}
    assert [got[i]["degree"] for i in range(1, 6)] == [2, 2, 3, 1, 0]
    assert [got[i]["core_number"] for i in range(1, 6)] == [2, 2, 2, 1, 0]
    assert got[5]["community_id"] == -1 and got[3]["betweenness_centrality"] == pytest.approx(2 / 3)
