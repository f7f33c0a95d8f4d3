"""Transaction and device graphs: construction, centrality, communities, node features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.times import whole_days
from riskspark.plans.chains import two_core
from riskspark.plans.fixpoint import both_ways, cut, iterate, side_by_side
from riskspark.plans.power import Power
from riskspark.plans.reach import ROW_BYTES, distance_sums, numbered
from riskspark.plans.running import below
from riskspark.plans.spread import Spread, binary, matrix, with_columns

# Weights of the community suspicion score and the size it peaks at.
DENSITY_W, VELOCITY_W, GINI_W, SIZE_W, PEAK_SIZE = 0.3, 0.3, 0.2, 0.2, 5
PIVOTS = 100


# --- construction -----------------------------------------------------------------------

def transaction_graph(transactions: DataFrame) -> DataFrame:
    """Undirected customer-beneficiary edges with count, amount, times and products."""
    a, b = F.col("customer_id"), F.col("beneficiary_id")
    edges = (transactions.where(b.isNotNull())
             .groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(
                 F.count(F.lit(1)).alias("transaction_count"),
                 F.sum(F.col("amount").cast("double")).alias("total_amount"),
                 F.min("timestamp").alias("first_transaction"),
                 F.max("timestamp").alias("last_transaction"),
                 F.array_sort(F.collect_set("product_type")).alias("product_types")))
    days = whole_days(F.col("last_transaction"), F.col("first_transaction"))
    return edges.withColumn("days_active", F.greatest(days, F.lit(1)).cast("bigint"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Edges between different nodes: structure measures ignore self-loops."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def graph_nodes(transactions: DataFrame) -> DataFrame:
    return (transactions.select(F.col("customer_id").alias("id"))
            .unionByName(transactions.where("beneficiary_id IS NOT NULL").select(F.col("beneficiary_id").alias("id")))
            .distinct())


def node_attributes(transactions: DataFrame) -> DataFrame:
    """Attributes of customer nodes; nodes seen only as beneficiary carry just their type."""
    amount = F.col("amount").cast("double")
    stats = transactions.groupBy(F.col("customer_id").alias("id")).agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum(amount).alias("total_volume"),
        F.avg(amount).alias("avg_amount"), F.size(F.collect_set("product_type")).cast("bigint").alias("product_diversity"),
        whole_days(F.max("timestamp"), F.min("timestamp")).alias("days_active"))
    partners = (transactions.where("beneficiary_id IS NOT NULL").select(F.col("customer_id").alias("id"), "beneficiary_id")
                .distinct().groupBy("id").agg(F.count(F.lit(1)).alias("unique_beneficiaries")))
    out = graph_nodes(transactions).join(stats, "id", "left").join(partners, "id", "left")
    kind = F.when(F.col("transaction_count").isNotNull(), "customer").otherwise("beneficiary")
    return out.withColumn("node_type", kind).withColumn(
        "unique_beneficiaries", F.when(F.col("transaction_count").isNotNull(),
                                       F.coalesce("unique_beneficiaries", F.lit(0))))


def device_members(transactions: DataFrame) -> DataFrame:
    """The device graph: (device_id, customer_id, device_users) of every device with more
    than one customer.

    Two customers share a device when both are its members. This form is
    complete and linear at every size; pairs are made for chosen customers only.
    """
    pairs = transactions.where("device_id IS NOT NULL").select("device_id", "customer_id").distinct()
    users = pairs.groupBy("device_id").agg(F.count(F.lit(1)).alias("device_users")).where("device_users > 1")
    return pairs.join(users, "device_id")


def device_pairs(members: DataFrame, ids: DataFrame) -> DataFrame:
    """All pairs (src < dst) with a shared device in which a customer of ``ids`` takes part.

    The work is the number of co-users of the customers asked for.
    """
    asked = ids.select("customer_id").distinct()
    own = members.join(asked, "customer_id", "left_semi").select("device_id", F.col("customer_id").alias("a"))
    met = own.join(members.select("device_id", F.col("customer_id").alias("b")), "device_id").where("a <> b")
    return (met.select("device_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared_devices"),
                                       F.array_sort(F.collect_list("device_id")).alias("device_ids")))


def device_fingerprints(transactions: DataFrame) -> DataFrame:
    """Per device: number of customers, shared flag, sessions, first and last use."""
    used = transactions.where("device_id IS NOT NULL").groupBy("device_id", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return used.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("customer_count"), (F.count(F.lit(1)) > 1).alias("is_shared"),
        F.sum("n").cast("bigint").alias("session_count"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))


def relationships(transactions: DataFrame) -> DataFrame:
    """Typed relationships: money transfers between customers, and customers on shared devices.

    A shared device is a row per member (``dst`` null, ``strength`` the number of
    other members), so the table is complete and linear; ``device_pairs`` lists
    the partners of chosen customers.
    """
    money = transaction_graph(transactions).where("src <> dst").select(
        "src", "dst", F.lit(None).cast("string").alias("device_id"), F.lit("transfer").alias("relationship_type"),
        F.col("transaction_count").alias("strength"), "total_amount", "first_transaction", "last_transaction")
    used = transactions.where("device_id IS NOT NULL").groupBy("device_id", F.col("customer_id").alias("src")).agg(
        F.min("timestamp").alias("first_transaction"), F.max("timestamp").alias("last_transaction"))
    users = used.groupBy("device_id").agg((F.count(F.lit(1)) - 1).alias("strength")).where("strength > 0")
    shared = used.join(users, "device_id").select(
        "src", F.lit(None).cast(transactions.schema["customer_id"].dataType).alias("dst"), "device_id",
        F.lit("shared_device").alias("relationship_type"), "strength", F.lit(0.0).alias("total_amount"),
        "first_transaction", "last_transaction")
    return money.unionByName(shared)


# --- local structure --------------------------------------------------------------------

def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(simple_edges(edges)).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    size = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return nodes.join(degrees(edges), "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).alias("degree"),
        (F.coalesce("degree", F.lit(0)) / (size - 1)).alias("degree_centrality"))


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    """Mean and population deviation of the neighbours' degrees."""
    links = both_ways(simple_edges(edges))
    near = degrees(edges).select(F.col("id").alias("dst"), "degree")
    return links.join(near, "dst").groupBy(F.col("src").alias("id")).agg(
        F.avg("degree").alias("neighbor_degree_mean"), F.stddev_pop("degree").alias("neighbor_degree_std"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles and clustering coefficient of every node.

    Edges point from the lower to the higher (degree, id), so no node keeps more
    than about sqrt(2 * edges) out-neighbours however popular it is; the third
    corner is the overlap of two such short lists.
    """
    e = cut(simple_edges(edges))
    d = degrees(e)
    ranked_edges = (e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src")
                    .join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst"))
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    directed = cut(ranked_edges.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"),
                                   F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")))
    out = directed.groupBy("u").agg(F.collect_list("v").alias("heads"))
    third = (directed.join(out, "u").join(out.select(F.col("u").alias("v"), F.col("heads").alias("heads_v")), "v")
             .select("u", "v", F.array_intersect("heads", "heads_v").alias("w")).where(F.size("w") > 0))
    n = F.size("w").cast("bigint")
    corner = F.concat(F.array(F.struct(F.col("u").alias("id"), n.alias("n")), F.struct(F.col("v").alias("id"), n.alias("n"))),
                      F.transform("w", lambda x: F.struct(x.alias("id"), F.lit(1).cast("bigint").alias("n"))))
    counts = third.select(F.explode(corner).alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("t"))
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return d.join(counts, "id", "left").select(
        "id", F.coalesce("t", F.lit(0)).cast("bigint").alias("triangles"),
        F.when(possible > 0, F.coalesce("t", F.lit(0)) / possible).otherwise(0.0).alias("clustering_coefficient"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """Core number: 1 outside the 2-core, inside it by repeated h-index of the neighbours' values, from the degree down.

    The 2-core is found by taking away trees and chains in logarithmic rounds (``plans.chains``), so
    long chains, which would settle by two nodes a round, cost no rounds below; chains inside the 2-core are
    settled at once. Neighbour values are counted per (node, value) before they are ranked, so a
    node of any degree contributes few rows.
    """
    edges = cut(simple_edges(edges))
    kept = cut(two_core(edges))
    inner = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(
        kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = cut(both_ways(inner))
    start = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core_number"))

    def step(state: DataFrame) -> DataFrame:
        from pyspark.sql import Window
        theirs = state.select(F.col("id").alias("dst"), F.col("core_number").alias("v"))
        own = state.select(F.col("id").alias("src"), "core_number")
        counted = (links.join(theirs, "dst").groupBy("src", "v").agg(F.count(F.lit(1)).alias("n"))
                   .join(own, "src").groupBy("src", "core_number", F.least("v", "core_number").alias("v"))
                   .agg(F.sum("n").alias("n")))
        above = Window.partitionBy("src").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
        return (counted.withColumn("reach", F.least("v", F.sum("n").over(above)))
                .groupBy(F.col("src").alias("id"), F.col("core_number").alias("old")).agg(F.max("reach").alias("core_number"))
                .select("id", "core_number", (F.col("core_number") != F.col("old")).alias("changed")))

    outside = both_ways(edges).select(F.col("src").alias("id")).distinct().join(kept, "id", "left_anti")
    return iterate(start, step, "changed").unionByName(outside.withColumn("core_number", F.lit(1).cast("bigint")))


def neighbour_means(edges: DataFrame, features: DataFrame, columns: Sequence[str], hops: int = 2) -> DataFrame:
    """Mean of each feature over the neighbours, repeated per hop (``{column}_hop{k}``)."""
    links = both_ways(simple_edges(edges))
    out, current = features, features.select("id", *columns)
    for k in range(1, hops + 1):
        near = current.select(F.col("id").alias("dst"), *columns)
        current = links.join(near, "dst").groupBy(F.col("src").alias("id")).agg(
            *[F.avg(c).alias(c) for c in columns])
        out = out.join(current.select("id", *[F.col(c).alias(f"{c}_hop{k}") for c in columns]), "id", "left")
    return out


# --- distances and centrality -----------------------------------------------------------

def choose_pivots(nodes: DataFrame, k: int | None, seed: int = 42) -> DataFrame:
    """All nodes, or the k with the smallest seeded hash."""
    if k is None:
        return nodes.select("id")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return nodes.select("id").orderBy(key, "id").limit(k)


def _sums_over_pivots(spread: Spread, places: DataFrame, first: int) -> DataFrame:
    """(id, s): dependencies of the nodes on the pivots numbered from ``first``, as many as a row holds.

    Forth, a row has the number of shortest paths to each pivot at the level just reached; back, the share of a
    node's dependency for each such path. Edges are undirected, so a pivot's levels follow one another.
    """
    width = spread.width

    def own(nodes: pa.Table) -> pa.Table:
        paths, level = np.zeros((len(nodes), width)), np.full((len(nodes), width), -1, np.int32)
        pivot = pc.fill_null(nodes["pivot"], -1).to_numpy() - first
        mine = np.flatnonzero((pivot >= 0) & (pivot < width))
        paths[mine, pivot[mine]], level[mine, pivot[mine]] = 1.0, 0
        return with_columns(nodes.drop_columns("pivot"), row=binary(paths, ~(level == 0).any(axis=1)), paths=binary(paths),
                            level=binary(level), total=pa.array(np.zeros(len(nodes))))

    def forth(depth: int):
        def settle(state: pa.Table, got: np.ndarray) -> pa.Table:
            paths, level = matrix(state["paths"], width).copy(), matrix(state["level"], width, np.int32).copy()
            new = (level < 0) & (got > 0)
            paths[new], level[new] = got[new], depth
            return with_columns(state, row=binary(np.where(new, paths, 0.0), ~new.any(axis=1)), paths=binary(paths), level=binary(level))
        return settle

    def back(depth: int):
        def settle(state: pa.Table, got: np.ndarray) -> pa.Table:
            paths, here = matrix(state["paths"], width), matrix(state["level"], width, np.int32) == depth
            delta = np.where(here, paths * got, 0.0)
            share = np.divide(1 + delta, paths, out=np.zeros_like(delta), where=here)
            return with_columns(state, row=binary(share, ~here.any(axis=1)), total=pa.array(state["total"].to_numpy() + delta.sum(axis=1)))
        return settle

    state = cut(spread.start(places, own, "row binary, paths binary, level binary, total double"))
    depth = 0
    while not state.where("row IS NOT NULL").isEmpty():
        depth += 1
        state = cut(spread.moved(state, forth(depth)))
    # The last level is empty, and nobody depends on the one before it.
    for depth in range(depth - 1, 0, -1):
        state = cut(spread.moved(state, back(depth)))
    return state.select("id", F.col("total").alias("s"))


def betweenness(edges: DataFrame, nodes: DataFrame, k: int | None = PIVOTS) -> DataFrame:
    """Normalised betweenness from k pivots (``None``: all nodes, exact).

    Each node has a row of numbers, one per pivot; pivots are taken ``PIVOTS`` at a time.
    """
    pivots = cut(choose_pivots(nodes, k))
    n, used = nodes.count(), pivots.count()
    spread = Spread(cut(simple_edges(edges)), nodes, max(1, min(used, PIVOTS)))
    places = cut(spread.places.join(numbered(pivots, -(-used // (1 << 16))).select("id", F.col("idx").alias("pivot")), "id", "left")
                 .select("home", "id", "blocks", "pivot"))
    parts = [_sums_over_pivots(spread, places, first) for first in range(0, used, spread.width)]
    scale = n / used / ((n - 1) * (n - 2))
    sums = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("s"))
    return nodes.join(sums, "id", "left").select(
        "id", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness_centrality"))


def closeness(edges: DataFrame, nodes: DataFrame, method: str = "sketch") -> DataFrame:
    """Closeness, scaled by the share of reachable nodes.

    ``exact`` keeps a bit per source and node, the sources in slices of bounded rows: bounded in
    memory, quadratic in time. ``sketch`` keeps one row of registers per node, so its state is linear in
    the nodes; as long as a bit per source takes no more room than that, it counts exactly as well.
    """
    sketched = method == "sketch" and nodes.count() > 8 * ROW_BYTES
    sums = distance_sums(cut(simple_edges(edges)), nodes, sketched)
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    r, total = F.coalesce("r", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
    return nodes.join(sums, "id", "left").select(
        "id", F.when(total > 0, r / total * r / (n - 1)).otherwise(0.0).alias("closeness_centrality"))


def eigenvector(edges: DataFrame, nodes: DataFrame, tolerance: float = 1e-6, max_rounds: int = 200,
                stride: int = 5) -> DataFrame:
    """Dominant eigenvector of the adjacency by power iteration on I + A.

    ``stride`` multiplications share one plan before the vector is normalised,
    tested and checkpointed.
    """
    size = nodes.count()
    power = Power(cut(simple_edges(edges)), nodes)
    state = power.start(1.0 / size)
    for _ in range(max_rounds):
        for _ in range(stride):
            state = power.product(state)
        state = cut(state)
        nx, np_ = power.total(state, lambda x, p: x ** 2) ** 0.5, power.total(state, lambda x, p: p ** 2) ** 0.5
        if power.total(state, lambda x, p: abs(x / nx - p / np_)) < size * tolerance:
            return power.values(state).select("id", (F.col("x") / nx).alias("eigenvector_centrality"))
        state = power.scaled(state, 1 / nx)
    raise RuntimeError("power iteration did not settle")


# --- communities ------------------------------------------------------------------------

def _parity(id_column: str, round_number: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit(round_number // 2)), F.lit(2)) == round_number % 2


def label_propagation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node takes the most frequent label around it; it keeps its own on a tie.

    Half of the nodes (by a hash that differs from round to round) move at a time,
    which stops neighbours from swapping labels for ever. Ties between other
    labels go to the smallest. It ends when neither half has a move.
    """
    links = cut(both_ways(simple_edges(edges)))
    state = cut(nodes.select("id", F.col("id").alias("community")))

    def half(s: DataFrame, number: int) -> DataFrame:
        near = s.select(F.col("id").alias("dst"), F.col("community").alias("label"))
        counts = (links.join(near, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
                  .join(s.where(_parity("id", number)), "id"))
        best = counts.groupBy("id").agg(
            F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"), F.max("n").alias("top"),
            F.max(F.when(F.col("label") == F.col("community"), F.col("n"))).alias("own"))
        moves = best.where(F.coalesce("own", F.lit(0)) < F.col("top")).select("id", "best")
        return s.join(moves, "id", "left").select("id", F.coalesce("best", "community").alias("community"),
                                                  F.col("best").isNotNull().alias("moved"))

    quiet = number = 0
    # Two quiet rounds are a whole pass only if they are the two halves of one hash.
    while quiet < 2 or number % 2:
        state = cut(half(state, number))
        quiet = quiet + 1 if state.where("moved").isEmpty() else 0
        state = state.drop("moved")
        number += 1
    return state


def modularity(weighted: DataFrame, communities: DataFrame) -> float:
    """Modularity of an assignment on edges (src, dst, weight), self-loops included."""
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = weighted.join(a, "src").join(b, "dst")
    ends = F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inside")),
                   F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside")))
    by = e.select("weight", F.explode(ends).alias("x")).groupBy("x.c").agg(
        F.sum("x.inside").alias("inside"), F.sum("weight").alias("total"))
    row = by.agg((F.sum("inside") * 2).alias("inside2"), F.sum("total").alias("m2"),
                 F.sum(F.col("total") ** 2).alias("squares")).first()
    m2 = row["m2"] or 0.0
    return 0.0 if m2 == 0 else row["inside2"] / m2 - row["squares"] / (m2 * m2)


def _move_round(links: DataFrame, strength: DataFrame, state: DataFrame, m2: float, number: int) -> DataFrame:
    """Half of the nodes move to the neighbouring community with the largest gain."""
    own = state.join(strength, "id", "left").fillna(0.0, ["k"])
    totals = own.groupBy(F.col("community").alias("target")).agg(F.sum("k").alias("sigma"))
    toward = (links.join(state.select(F.col("id").alias("dst"), F.col("community").alias("target")), "dst")
              .select(F.col("src").alias("id"), "target", F.col("weight").alias("w")))
    stay = state.select("id", F.col("community").alias("target"), F.lit(0.0).alias("w"))
    options = (toward.unionByName(stay).where(_parity("id", number)).groupBy("id", "target").agg(F.sum("w").alias("w"))
               .join(own, "id").join(totals, "target"))
    outside = F.col("sigma") - F.when(F.col("target") == F.col("community"), F.col("k")).otherwise(0.0)
    scored = options.withColumn("gain", F.round(F.col("w") - outside * F.col("k") / m2, 9))
    best = scored.groupBy("id").agg(
        F.min_by("target", F.struct(-F.col("gain"), "target")).alias("best"), F.max("gain").alias("top"),
        F.max(F.when(F.col("target") == F.col("community"), F.col("gain"))).alias("own"))
    moves = best.where("top > own").select("id", "best")
    return state.join(moves, "id", "left").select("id", F.coalesce("best", "community").alias("community"))


def modularity_communities(edges: DataFrame, nodes: DataFrame, least_gain: float = 1e-3) -> DataFrame:
    """Communities by local moving and contraction, both as whole-table rounds.

    A round is kept only if modularity rises, so the result never gets worse;
    contraction then repeats the moves between communities. A level ends
    when two rounds in a row gain less than ``least_gain``, and the last level is
    one that gains no more than that; modularity is at most 1, so both end.
    """
    level_edges = cut(simple_edges(edges).withColumn("weight", F.lit(1.0)))
    assignment = cut(nodes.select("id", F.col("id").alias("community")))
    best = modularity(level_edges, assignment)
    m2 = 2.0 * (level_edges.agg(F.sum("weight")).first()[0] or 0.0)
    while m2 > 0:
        start = best
        turned = level_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        # A self-loop counts twice towards its node's strength and never towards a move.
        strength = cut(level_edges.unionByName(turned).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
        links = cut(level_edges.unionByName(turned).where("src <> dst"))
        state = cut(assignment.select(F.col("community").alias("id")).distinct().withColumn("community", F.col("id")))
        idle = number = 0
        while idle < 2:
            trial = cut(_move_round(links, strength, state, m2, number))
            number += 1
            q = modularity(level_edges, trial)
            idle = 0 if q > best + least_gain else idle + 1
            if q > best:
                state, best = trial, q
        if best <= start + least_gain:
            break
        joined = assignment.join(state.select(F.col("id").alias("community"), F.col("community").alias("next")), "community")
        assignment = cut(joined.select("id", F.col("next").alias("community")))
        a = state.select(F.col("id").alias("src"), F.col("community").alias("ca"))
        b = state.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
        level_edges = cut(level_edges.join(a, "src").join(b, "dst")
                          .groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst"))
                          .agg(F.sum("weight").alias("weight")))
    return assignment


def community_sizes(communities: DataFrame) -> DataFrame:
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("community_size"))
    return communities.join(sizes, "community").select("id", F.col("community").alias("community_id"), "community_size")


def community_metrics(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Size, density, clustering, degree, velocity and amount inequality per community.

    Ranks of equal amounts are consecutive, so their sum follows from the number of
    ties and of smaller amounts: distinct amounts are placed in value buckets, and
    neither one giant community nor one common amount is sorted by a single task.
    """
    a = communities.select(F.col("id").alias("src"), "community")
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    inside = cut(edges.where("src <> dst").join(a, "src").join(b, "dst").where("community = other")
                 .select("community", "src", "dst", "transaction_count", "total_amount", "days_active"))
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    ties = inside.groupBy("community", "total_amount").agg(F.count(F.lit(1)).alias("c"))
    ranks = F.col("c") * F.col("smaller") + F.col("c") * (F.col("c") + 1) / 2
    weighted = (below(ties, ["community"], "total_amount", "c", "smaller").groupBy("community")
                .agg(F.sum(ranks * F.col("total_amount")).alias("weighted")))
    sums = inside.groupBy("community").agg(
        F.count(F.lit(1)).alias("m"), F.avg(F.col("transaction_count") / F.greatest("days_active", F.lit(1))).alias("velocity"),
        F.sum("total_amount").alias("amount")).join(weighted, "community")
    local = triangles(inside)
    clustering = (communities.join(local, "id", "left").groupBy("community")
                  .agg(F.avg(F.coalesce("clustering_coefficient", F.lit(0.0))).alias("avg_clustering")))
    m, n = F.coalesce("m", F.lit(0)), F.col("size")
    gini = 2 * F.col("weighted") / (F.col("m") * F.col("amount")) - (F.col("m") + 1) / F.col("m")
    return sizes.join(sums, "community", "left").join(clustering, "community", "left").select(
        "community", "size",
        F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"),
        F.when(n > 1, F.col("avg_clustering")).otherwise(0.0).alias("avg_clustering"),
        (2 * m / n).alias("avg_degree"),
        F.coalesce("velocity", F.lit(0.0)).alias("transaction_velocity"),
        F.when(m < 2, 0.0).otherwise(gini).alias("amount_concentration"))


def community_suspicion(metrics: DataFrame) -> DataFrame:
    size_term = F.greatest(F.lit(0.0), 1 - F.abs(F.col("size") - PEAK_SIZE) / 10)
    score = (F.col("density") * DENSITY_W + F.least(F.col("transaction_velocity") / 10, F.lit(1.0)) * VELOCITY_W
             + F.col("amount_concentration") * GINI_W + size_term * SIZE_W)
    return metrics.withColumn("fraud_score", F.least(score, F.lit(1.0)))


# --- node feature table -----------------------------------------------------------------

NODE_DEFAULTS = {"community_id": -1}


def node_features(customers: DataFrame, transactions: DataFrame, native_only: bool = False,
                  pivots: int | None = PIVOTS, closeness_method: str = "sketch") -> DataFrame:
    """Graph columns of every customer; customers outside the graph get the defaults.

    Each measure is a loop of many small rounds, so the loops run side by side.
    """
    edges = cut(transaction_graph(transactions).select("src", "dst"))
    nodes = cut(graph_nodes(transactions))
    measures = [lambda: degree_centrality(edges, nodes), lambda: neighbour_degrees(edges), lambda: triangles(edges),
                lambda: core_numbers(edges).withColumn("k_core", F.col("core_number"))]
    if not native_only:
        measures += [lambda: betweenness(edges, nodes, pivots), lambda: closeness(edges, nodes, closeness_method),
                     lambda: eigenvector(edges, nodes), lambda: community_sizes(modularity_communities(edges, nodes))]
    parts = side_by_side(edges.sparkSession, lambda measure: measure(), measures)
    out = customers.select(F.col("customer_id").alias("id"))
    for p in parts:
        out = out.join(p, "id", "left")
    numeric = {f.name: -1 if f.name == "community_id" else 0 for f in out.schema.fields
               if f.name != "id" and isinstance(f.dataType, T.NumericType)}
    return out.fillna(numeric).withColumnRenamed("id", "customer_id")
