"""Monitoring and freshness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalog.base import ASOF_SQL, query, rounded
from riskspark.catalog.decisions import ACTION, LEVELED, decisions
from riskspark.operators import monitor
from riskspark.sources.driver import AS_OF

STATS = """count(value) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean,
  round(quantile_cont(value, 0.5), 4) AS median, round(coalesce(stddev_samp(value), 0), 4) AS std_dev,
  round(list_sort(list(value))[CAST(least(floor(0.95::DOUBLE * count(value)), count(value) - 1) AS INTEGER) + 1], 4) AS p95,
  round(list_sort(list(value))[CAST(least(floor(0.99::DOUBLE * count(value)), count(value) - 1) AS INTEGER) + 1], 4) AS p99"""


@query("metric_summary", f"SELECT name, {STATS} FROM mp WHERE timestamp >= {ASOF_SQL} - INTERVAL 10080 MINUTE AND timestamp <= {ASOF_SQL} GROUP BY 1", "mp")
def metric_summary(t):
    return rounded(monitor.metric_summary(t.metric_points(), AS_OF, minutes=10080))


@query("counters", """SELECT name, '{"channel":"' || channel || '"}' AS label_key, count(*) AS n FROM mp GROUP BY 1, 2""", "mp")
def counters(t):
    return monitor.counters(t.metric_points())


@query("timer_summary", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY name, channel ORDER BY timestamp DESC, point_id DESC) AS pos FROM mp)
SELECT name, '{{"channel":"' || channel || '"}}' AS label_key, {STATS} FROM r WHERE pos <= 200 GROUP BY 1, 2""", "mp")
def timer_summary(t):
    """Latest values per timer, here two hundred."""
    return rounded(monitor.timer_summary(t.metric_points(), "point_id", last=200))


@query("derived_rates", """
SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS request_count,
  round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1) * 100, 4) AS error_rate,
  round(count(*) FILTER (WHERE k < 60) / greatest(count(*), 1) * 100, 4) AS cache_hit_rate,
  round(avg(value), 4) AS average_response_time, round(count(*) / 86400.0::DOUBLE, 4) AS throughput FROM ev GROUP BY 1""", "ev")
def derived_rates(t):
    e = t.events().select(F.col("ts").alias("timestamp"), (F.col("event_type") == "error").alias("is_error"),
                          (F.col("k") < 60).alias("cache_hit"), F.col("value").alias("latency_ms"))
    return rounded(monitor.derived_rates(e))


@query("retention", f"SELECT point_id, name FROM mp WHERE timestamp >= {ASOF_SQL} - INTERVAL 48 HOUR", "mp")
def retention(t):
    return monitor.retain(t.metric_points(), AS_OF, hours=48).select("point_id", "name")


def _rules(t):
    """Limits per metric, as a one-row-per-metric table derived from the metric names."""
    names = t.metric_points().select(F.col("name").alias("metric")).distinct()
    return names.select("metric", F.when(F.col("metric") == "error", 90.0).otherwise(60.0).alias("threshold"),
                        (F.col("metric") == "view").alias("below"), (F.col("metric") == "error").alias("always_critical"))


ALERTS = """
SELECT point_id AS alert_id, name AS kind, timestamp, value, CASE WHEN name = 'error' THEN 90.0 ELSE 60.0 END::DOUBLE AS threshold,
  CASE WHEN name = 'error' THEN 'critical' WHEN value < 90 THEN 'warning' ELSE 'critical' END AS severity FROM mp
WHERE CASE WHEN name = 'view' THEN value < 60 WHEN name = 'error' THEN value > 90 ELSE value > 60 END"""


def alerts(t):
    points = t.metric_points().select(F.col("name").alias("metric"), "timestamp", "value", F.col("point_id").alias("alert_id"))
    found = monitor.threshold_alerts(points, _rules(t))
    return found.select("alert_id", F.col("metric").alias("kind"), "timestamp", "value", "threshold", "severity")


@query("threshold_alerts", ALERTS, "mp")
def threshold_alerts(t):
    return alerts(t)


@query("cooled_alerts", f"""
WITH RECURSIVE al AS (SELECT kind, timestamp, min(alert_id) AS alert_id FROM ({ALERTS}) GROUP BY 1, 2),
kp(kind, timestamp) AS (SELECT kind, min(timestamp) FROM al GROUP BY 1
  UNION ALL SELECT n.kind, n.timestamp FROM (SELECT kp.kind, (SELECT min(al.timestamp) FROM al WHERE al.kind = kp.kind
    AND al.timestamp > kp.timestamp + INTERVAL 720 MINUTE) AS timestamp FROM kp) n WHERE n.timestamp IS NOT NULL)
SELECT al.kind, al.alert_id FROM al JOIN kp ON al.kind = kp.kind AND al.timestamp = kp.timestamp""", "mp")
def cooled_alerts(t):
    """Alerts left after a cooldown, here twelve hours so that several remain per run."""
    return monitor.cooled_alerts(alerts(t), minutes=720).select("kind", "alert_id")


@query("event_log", f"""
SELECT '{{"action":"' || {ACTION} || '","transaction_id":"' || transaction_id || '"}}' AS fields,
  CASE WHEN lvl = 'high' THEN 'WARNING' ELSE 'INFO' END AS level, 'transaction_processed' AS event_type FROM ({LEVELED})""", "tx sc")
def event_log(t):
    from riskspark.functions.times import as_time
    d = decisions(t).withColumn("timestamp", as_time(AS_OF))
    level = F.when(F.col("risk_level") == "high", "WARNING").otherwise("INFO")
    rows = monitor.log_rows(d, "transaction_processed", {"action": F.col("action"), "transaction_id": F.col("transaction_id")}, level)
    return rows.select("event_type", "level", F.to_json("fields").alias("fields"))


@query("decision_metric_points", f"""
SELECT n AS name, '{{}}' AS labels, round(v, 4) AS value, transaction_id FROM (
  SELECT transaction_id, unnest(['hub_risk_score','spoke_fraud_score','final_fraud_score']) AS n, unnest([h, s, f]) AS v FROM ({LEVELED}))
UNION ALL SELECT 'fraud_detections_total', '{{"risk_level":"' || lvl || '"}}', 1, transaction_id FROM ({LEVELED})
UNION ALL SELECT 'fraud_actions_total', '{{"action":"' || {ACTION} || '"}}', 1, transaction_id FROM ({LEVELED})""", "tx sc")
def decision_metric_points(t):
    from riskspark.functions.times import as_time
    points = monitor.decision_metrics(decisions(t).withColumn("timestamp", as_time(AS_OF)))
    return rounded(points.select("name", F.to_json("labels").alias("labels"), "value", "transaction_id"))


def stored(t):
    """Feature rows written over time: one per event, as if computed at its time."""
    return t.transactions().select(
        "customer_id", F.when(F.col("transaction_id") % 2 == 0, "profile").otherwise("network").alias("pillar"),
        F.col("timestamp").alias("computed_at"), F.col("amount").alias("payload"), "transaction_id")


STORED = "SELECT customer_id, CASE WHEN transaction_id % 2 = 0 THEN 'profile' ELSE 'network' END AS pillar, timestamp AS computed_at, amount AS payload, transaction_id FROM tx"
FRESH = f"""
SELECT customer_id, pillar, computed_at, round(payload, 4) AS payload, transaction_id FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, pillar ORDER BY computed_at DESC, payload DESC, transaction_id DESC) AS rn FROM ({STORED})
  WHERE computed_at > {ASOF_SQL} - INTERVAL 86400 SECOND AND computed_at <= {ASOF_SQL}) WHERE rn = 1"""


@query("fresh_features", FRESH, "tx")
def fresh_features(t):
    """Newest stored feature row per customer and pillar younger than a day."""
    return rounded(monitor.latest_fresh(stored(t), ["customer_id", "pillar"], AS_OF, ttl_seconds=86400))


@query("stale_features", f"""
SELECT c.customer_id, p.pillar FROM (SELECT DISTINCT customer_id FROM tx) c, (SELECT unnest(['profile','network']) AS pillar) p
WHERE (c.customer_id, p.pillar) NOT IN (SELECT (customer_id, pillar) FROM ({FRESH}))""", "tx")
def stale_features(t):
    """Keys whose stored value is too old and must be computed again."""
    keys = ["customer_id", "pillar"]
    wanted = t.transactions().select("customer_id", F.explode(F.array(F.lit("profile"), F.lit("network"))).alias("pillar"))
    return monitor.stale_keys(wanted, monitor.latest_fresh(stored(t), keys, AS_OF, 86400), keys)


@query("invalidated_features", f"SELECT customer_id, pillar, transaction_id FROM ({STORED}) WHERE customer_id NOT IN (SELECT customer_id FROM fr)", "tx fr")
def invalidated_features(t):
    return monitor.invalidate(stored(t), t.fraud_records()).select("customer_id", "pillar", "transaction_id")


@query("invalidated_pillar", f"SELECT customer_id, pillar, transaction_id FROM ({STORED}) WHERE NOT (customer_id IN (SELECT customer_id FROM fr) AND pillar = 'network')", "tx fr")
def invalidated_pillar(t):
    return monitor.invalidate(stored(t), t.fraud_records(), "network").select("customer_id", "pillar", "transaction_id")


@query("drift", """
WITH b AS (SELECT 'amount' AS feature, (amount >= 5)::INT + (amount >= 20)::INT + (amount >= 60)::INT + (amount >= 150)::INT AS bucket, timestamp FROM tx
  UNION ALL SELECT 'hour', (hour(timestamp) >= 6)::INT + (hour(timestamp) >= 12)::INT + (hour(timestamp) >= 18)::INT, timestamp FROM tx),
s AS (SELECT feature, bucket, count(*) FILTER (WHERE timestamp < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (WHERE timestamp >= TIMESTAMP '2024-01-16') AS c FROM b GROUP BY 1, 2),
h AS (SELECT feature, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS p, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS q FROM s)
SELECT feature, round(sum((q - p) * ln(q / p)), 4) AS stability_index, sum((q - p) * ln(q / p)) > 0.1 AS drifted FROM h GROUP BY 1""", "tx")
def drift(t):
    """Later half of the month against the earlier half."""
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    rows = t.transactions().select("amount", F.hour("timestamp").alias("hour"), "timestamp")
    return rounded(monitor.drift(rows.where(F.col("timestamp") < middle), rows.where(F.col("timestamp") >= middle),
                                 {"amount": [5, 20, 60, 150], "hour": [6, 12, 18]}))
