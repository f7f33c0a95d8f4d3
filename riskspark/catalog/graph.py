"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalog.base import query, rounded
from riskspark.operators import graph
from riskspark.plans.fixpoint import cut

EDGES = """
SELECT least(customer_id, beneficiary_id) AS src, greatest(customer_id, beneficiary_id) AS dst, count(*) AS transaction_count,
  sum(amount) AS total_amount, min(timestamp) AS first_transaction, max(timestamp) AS last_transaction,
  array_to_string(list_sort(list(DISTINCT product_type)), ',') AS product_types,
  greatest((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 86400000000, 1) AS days_active
FROM tx WHERE beneficiary_id IS NOT NULL GROUP BY 1, 2"""
SIMPLE = f"SELECT src, dst FROM ({EDGES}) WHERE src <> dst"
LINKS = f"se AS ({SIMPLE}), lk AS (SELECT src, dst FROM se UNION ALL SELECT dst, src FROM se), dg AS (SELECT src AS id, count(*) AS degree FROM lk GROUP BY 1)"
NODES = "nd AS (SELECT customer_id AS id FROM tx UNION SELECT beneficiary_id FROM tx WHERE beneficiary_id IS NOT NULL)"
TRIANGLES = f"""
WITH {LINKS}, tr AS (SELECT a.src AS id, count(*) / 2 AS t FROM lk a JOIN lk b ON a.src = b.src JOIN lk c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT dg.id, CAST(coalesce(t, 0) AS BIGINT) AS triangles,
  round(CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 4) AS clustering_coefficient
FROM dg LEFT JOIN tr USING (id)"""


def edges(t):
    return graph.transaction_graph(t.transactions())


def small(t):
    """Edges and nodes of the transaction graph, written once for the loops."""
    return cut(edges(t).select("src", "dst")), cut(graph.graph_nodes(t.transactions()))


@query("transaction_graph", f"SELECT * REPLACE (round(total_amount, 4) AS total_amount) FROM ({EDGES})", "tx")
def transaction_graph(t):
    return rounded(edges(t).withColumn("product_types", F.array_join("product_types", ",")))


@query("trade_graph", """
SELECT customer_id AS src, beneficiary_id AS dst, count(*) AS transaction_count, round(sum(amount), 4) AS total_amount FROM trade GROUP BY 1, 2""", "trade")
def trade_graph(t):
    """The same builder on the larger customer-supplier graph."""
    return rounded(graph.transaction_graph(t.trade_edges()).select("src", "dst", "transaction_count", "total_amount"))


@query("node_attributes", f"""
WITH {NODES}, s AS (SELECT customer_id AS id, count(*) AS transaction_count, sum(amount) AS total_volume, avg(amount) AS avg_amount,
  count(DISTINCT product_type) AS product_diversity, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 86400000000 AS days_active,
  count(DISTINCT beneficiary_id) AS unique_beneficiaries FROM tx GROUP BY 1)
SELECT nd.id, transaction_count, round(total_volume, 4) AS total_volume, round(avg_amount, 4) AS avg_amount, product_diversity, days_active,
  unique_beneficiaries, CASE WHEN transaction_count IS NULL THEN 'beneficiary' ELSE 'customer' END AS node_type FROM nd LEFT JOIN s USING (id)""", "tx")
def node_attributes(t):
    return rounded(graph.node_attributes(t.transactions()))


DEVICE_PAIRS = """
SELECT a.customer_id AS src, b.customer_id AS dst, count(*) AS shared_devices, string_agg(a.device_id, ',' ORDER BY a.device_id) AS device_ids
FROM (SELECT DISTINCT customer_id, device_id FROM tx WHERE device_id IS NOT NULL) a
JOIN (SELECT DISTINCT customer_id, device_id FROM tx WHERE device_id IS NOT NULL) b
  ON a.device_id = b.device_id AND a.customer_id < b.customer_id GROUP BY 1, 2"""


@query("device_sharing_graph", DEVICE_PAIRS, "tx")
def device_sharing_graph(t):
    """Pairs for the customers of the bank, here all of them."""
    tx = t.transactions()
    pairs = graph.device_pairs(graph.device_members(tx), t.customers())
    return pairs.withColumn("device_ids", F.array_join("device_ids", ","))


@query("device_sharing_hubs", """
SELECT device_id, customer_id, n AS device_users FROM (SELECT DISTINCT device_id, customer_id FROM tx WHERE device_id IS NOT NULL)
JOIN (SELECT device_id, count(DISTINCT customer_id) AS n FROM tx WHERE device_id IS NOT NULL GROUP BY 1) USING (device_id) WHERE n > 4""", "tx")
def device_sharing_hubs(t):
    """The device graph, asked for devices above four users."""
    return graph.device_members(t.transactions()).where("device_users > 4")


@query("device_memberships", """
SELECT device_id, customer_id, n AS device_users FROM (SELECT DISTINCT device_id, customer_id FROM tx WHERE device_id IS NOT NULL)
JOIN (SELECT device_id, count(DISTINCT customer_id) AS n FROM tx WHERE device_id IS NOT NULL GROUP BY 1) USING (device_id) WHERE n > 1""", "tx")
def device_memberships(t):
    """The whole device graph as its two-sided table."""
    return graph.device_members(t.transactions())


@query("device_fingerprints", """
SELECT device_id, count(DISTINCT customer_id) AS customer_count, count(DISTINCT customer_id) > 1 AS is_shared, count(*) AS session_count,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM tx WHERE device_id IS NOT NULL GROUP BY 1""", "tx")
def device_fingerprints(t):
    return graph.device_fingerprints(t.transactions())


@query("customer_relationships", f"""
SELECT src, dst, NULL AS device_id, 'transfer' AS relationship_type, transaction_count AS strength, round(total_amount, 4) AS total_amount,
  first_transaction, last_transaction FROM ({EDGES}) WHERE src <> dst
UNION ALL SELECT customer_id, NULL, device_id, 'shared_device', n - 1, 0, min(timestamp), max(timestamp)
FROM tx JOIN (SELECT device_id, count(DISTINCT customer_id) AS n FROM tx WHERE device_id IS NOT NULL GROUP BY 1) USING (device_id)
WHERE n > 1 GROUP BY device_id, customer_id, n""", "tx")
def customer_relationships(t):
    return rounded(graph.relationships(t.transactions()))


@query("degree_centrality", f"""
WITH {LINKS}, {NODES} SELECT nd.id, coalesce(degree, 0) AS degree,
  round(coalesce(degree, 0) / ((SELECT count(*) FROM nd) - 1), 4) AS degree_centrality FROM nd LEFT JOIN dg USING (id)""", "tx")
def degree_centrality(t):
    return rounded(graph.degree_centrality(edges(t), graph.graph_nodes(t.transactions())))


@query("neighbour_degrees", f"""
WITH {LINKS} SELECT lk.src AS id, round(avg(degree), 4) AS neighbor_degree_mean, round(stddev_pop(degree), 4) AS neighbor_degree_std
FROM lk JOIN dg ON dg.id = lk.dst GROUP BY 1""", "tx")
def neighbour_degrees(t):
    return rounded(graph.neighbour_degrees(edges(t)))


@query("triangles", TRIANGLES, "tx")
def triangles(t):
    return rounded(graph.triangles(edges(t)))


@query("neighbour_means", f"""
WITH {LINKS}, ft AS (SELECT customer_id AS id, avg(amount) AS a FROM tx GROUP BY 1),
h1 AS (SELECT lk.src AS id, avg(a) AS a FROM lk JOIN ft ON ft.id = lk.dst GROUP BY 1),
h2 AS (SELECT lk.src AS id, avg(a) AS a FROM lk JOIN h1 ON h1.id = lk.dst GROUP BY 1)
SELECT ft.id, round(ft.a, 4) AS avg_amount, round(h1.a, 4) AS avg_amount_hop1, round(h2.a, 4) AS avg_amount_hop2
FROM ft LEFT JOIN h1 USING (id) LEFT JOIN h2 USING (id)""", "tx")
def neighbour_means(t):
    """Two rounds of neighbourhood mean aggregation of a node feature."""
    features = t.transactions().groupBy(F.col("customer_id").alias("id")).agg(F.avg("amount").alias("avg_amount"))
    return rounded(graph.neighbour_means(edges(t), features, ["avg_amount"]))


CORES = f"""
WITH RECURSIVE {LINKS}, st AS (SELECT 0 AS i, id, degree AS c FROM dg
  UNION ALL SELECT i + 1, src, CAST(max(least(c, k)) AS BIGINT) FROM (
    SELECT st.i, lk.src, st.c, row_number() OVER (PARTITION BY lk.src ORDER BY st.c DESC) AS k
    FROM st JOIN lk ON lk.dst = st.id WHERE st.i < 60) GROUP BY 1, 2)
SELECT id, c AS core_number FROM st WHERE i = 60"""


@query("core_numbers", CORES, "tx")
def core_numbers(t):
    """The SQL repeats the h-index of the neighbours' values sixty times, more often than the given graph needs."""
    return graph.core_numbers(edges(t))


@query("closeness_exact", f"""
WITH RECURSIVE {LINKS}, {NODES},
bf(s, id, d) AS (SELECT id, id, 0 FROM nd UNION SELECT bf.s, lk.dst, d + 1 FROM bf JOIN lk ON lk.src = bf.id WHERE d < 4),
sp AS (SELECT s, id, min(d) AS d FROM bf GROUP BY 1, 2), ag AS (SELECT s AS id, count(*) - 1 AS r, sum(d) AS tot FROM sp GROUP BY 1)
SELECT id, round(CASE WHEN tot > 0 THEN r / tot * r / ((SELECT count(*) FROM nd) - 1) ELSE 0 END, 4) AS closeness_centrality FROM ag""", "tx")
def closeness_exact(t):
    e, n = small(t)
    return rounded(graph.closeness(e, n, method="exact"))


@query("closeness_sketch")
def closeness_sketch(t):
    """Linear-state estimate; tests bound its error against the exact value."""
    e, n = small(t)
    return rounded(graph.closeness(e, n))


@query("betweenness")
def betweenness(t):
    """Pivot-based as defined; compared with direct accumulation on small graphs in the tests."""
    e, n = small(t)
    return rounded(graph.betweenness(e, n), 6)


@query("eigenvector_centrality")
def eigenvector_centrality(t):
    e, n = small(t)
    return rounded(graph.eigenvector(e, n))


@query("label_communities")
def label_communities(t):
    e, n = small(t)
    return graph.community_sizes(graph.label_propagation(e, n))


@query("modularity_communities")
def modularity_communities(t):
    e, n = small(t)
    return graph.community_sizes(graph.modularity_communities(e, n))


METRICS = f"""
WITH e AS (SELECT * FROM ({EDGES}) WHERE src <> dst AND src // 5 = dst // 5), {NODES}, cm AS (SELECT id, id // 5 AS community FROM nd),
sz AS (SELECT community, count(*) AS size FROM cm GROUP BY 1),
rk AS (SELECT *, src // 5 AS community, row_number() OVER (PARTITION BY src // 5 ORDER BY total_amount, src, dst) AS i FROM e),
sm AS (SELECT community, count(*) AS m, avg(transaction_count / days_active) AS vel, sum(i * total_amount) AS wt, sum(total_amount) AS amt FROM rk GROUP BY 1),
lk AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), dg AS (SELECT src AS id, count(*) AS degree FROM lk GROUP BY 1),
tr AS (SELECT a.src AS id, count(*) / 2 AS t FROM lk a JOIN lk b ON a.src = b.src JOIN lk c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1),
cl AS (SELECT community, avg(CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1) / 2) ELSE 0 END) AS ac
  FROM cm LEFT JOIN dg USING (id) LEFT JOIN tr USING (id) GROUP BY 1),
fin AS (SELECT sz.community, size, CASE WHEN size > 1 THEN 2 * coalesce(m, 0) / (size * (size - 1)) ELSE 0 END AS density,
  CASE WHEN size > 1 THEN ac ELSE 0 END AS avg_clustering, 2 * coalesce(m, 0) / size AS avg_degree, coalesce(vel, 0) AS transaction_velocity,
  CASE WHEN coalesce(m, 0) < 2 THEN 0 ELSE 2 * wt / (m * amt) - (m + 1) / m END AS amount_concentration
  FROM sz LEFT JOIN sm USING (community) LEFT JOIN cl USING (community))
SELECT community, size, round(density, 4) AS density, round(avg_clustering, 4) AS avg_clustering, round(avg_degree, 4) AS avg_degree,
  round(transaction_velocity, 4) AS transaction_velocity, round(amount_concentration, 4) AS amount_concentration,
  round(least(density * 0.3::DOUBLE + least(transaction_velocity / 10, 1) * 0.3::DOUBLE + amount_concentration * 0.2::DOUBLE
    + greatest(0, 1 - abs(size - 5) / 10) * 0.2::DOUBLE, 1), 4) AS fraud_score FROM fin"""


@query("community_suspicion", METRICS, "tx")
def community_suspicion(t):
    """Metrics and suspicion score of a given assignment (customer rings)."""
    communities = graph.graph_nodes(t.transactions()).withColumn("community", F.expr("id div 5"))
    return rounded(graph.community_suspicion(graph.community_metrics(edges(t), communities)))


@query("node_features_native", f"""
WITH {LINKS}, {NODES}, cn AS ({CORES}), tg AS ({TRIANGLES}),
nb AS (SELECT lk.src AS id, avg(degree) AS m, stddev_pop(degree) AS s FROM lk JOIN dg ON dg.id = lk.dst GROUP BY 1)
SELECT c_custkey AS customer_id, coalesce(degree, 0) AS degree, CASE WHEN nd.id IS NULL THEN 0 ELSE
    round(coalesce(degree, 0) / ((SELECT count(*) FROM nd) - 1), 4) END AS degree_centrality,
  coalesce(round(m, 4), 0) AS neighbor_degree_mean, coalesce(round(s, 4), 0) AS neighbor_degree_std, coalesce(triangles, 0) AS triangles,
  coalesce(clustering_coefficient, 0) AS clustering_coefficient, coalesce(core_number, 0) AS core_number, coalesce(core_number, 0) AS k_core
FROM customer LEFT JOIN nd ON nd.id = c_custkey LEFT JOIN dg ON dg.id = c_custkey LEFT JOIN nb ON nb.id = c_custkey
LEFT JOIN tg ON tg.id = c_custkey LEFT JOIN cn ON cn.id = c_custkey""", "tx")
def node_features_native(t):
    return rounded(graph.node_features(t.customers(), t.transactions(), native_only=True))


@query("node_features")
def node_features(t):
    """Every graph column for every customer."""
    return rounded(graph.node_features(t.customers(), t.transactions()))
