"""Monitoring tables: metric summaries, counters, alerts, freshness, drift, event log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.quantiles import exact_percentiles
from riskspark.functions.times import HOUR_US, MINUTE_US, as_time, hours_before, micros
from riskspark.plans.fixpoint import cut
from riskspark.plans.running import first_after, running

# Windows, retention, limits, freshness in seconds.
SUMMARY_MINUTES, RETENTION_HOURS, TIMER_VALUES = 60, 24, 1000
ERROR_RATE_LIMIT, CRITICAL_AT, COOLDOWN_MINUTES = 5.0, 90.0, 15
FEATURE_TTL, HUB_TTL = 3600, 300


def label_key(labels: Column) -> Column:
    """Labels as text in key order, so equal label sets give equal keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def summarize(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count, extremes, mean, median, sample deviation, and nearest-index p95 and p99."""
    stats = points.groupBy(*keys).agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_dev"))
    ranks = exact_percentiles(points, keys, "value", {"median": 0.5, "p95": 0.95, "p99": 0.99}, nearest={"p95", "p99"})
    return stats.join(ranks, keys)


def metric_summary(points: DataFrame, as_of, minutes: int = SUMMARY_MINUTES) -> DataFrame:
    at = micros(as_time(as_of))
    recent = points.where((micros("timestamp") >= at - minutes * MINUTE_US) & (micros("timestamp") <= at))
    return summarize(recent, ["name"])


def counters(points: DataFrame) -> DataFrame:
    return points.groupBy("name", label_key(F.col("labels")).alias("label_key")).agg(F.count(F.lit(1)).alias("n"))


def timer_summary(points: DataFrame, id_column: str, last: int = TIMER_VALUES) -> DataFrame:
    """Summary of the latest values per (name, labels).

    Counts per hour tell which of the newest hours hold them; only rows of these
    hours are placed, by bucketed running counts.
    """
    keyed = points.withColumn("label_key", label_key(F.col("labels"))).drop("labels")
    keys = ["name", "label_key"]
    hour = F.floor(micros("timestamp") / F.lit(HOUR_US)).cast("bigint").alias("__hour")
    counts = keyed.groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("__hour")).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("newer") < last)
    keyed = keyed.withColumn("__hour", hour).join(needed.select(*keys, "__hour"), [*keys, "__hour"], "left_semi").drop("__hour")
    placed = running(keyed, keys, "timestamp", [id_column], sums={"place": F.lit(1).cast("bigint")})
    sizes = needed.groupBy(*keys).agg(F.sum("n").alias("size"))
    recent = placed.join(sizes, keys).where(F.col("size") - F.col("place") < last)
    return summarize(recent, keys)


def derived_rates(events: DataFrame, bucket: str = "day") -> DataFrame:
    """Per period: request count, error and cache-hit percent, mean latency, rows per second."""
    count = F.count(F.lit(1))
    seconds = {"hour": 3600.0, "day": 86400.0}[bucket]

    def percent(part: Column, whole: Column) -> Column:
        return part / F.greatest(whole, F.lit(1)) * 100

    return events.groupBy(F.date_trunc(bucket, "timestamp").cast("timestamp_ntz").alias("period")).agg(
        count.alias("request_count"),
        percent(F.count_if("is_error"), count).alias("error_rate"),
        percent(F.count_if("cache_hit"), F.count("cache_hit")).alias("cache_hit_rate"),
        F.avg("latency_ms").alias("average_response_time"),
        (count / F.lit(seconds)).alias("throughput"))


def retain(points: DataFrame, as_of, hours: int = RETENTION_HOURS) -> DataFrame:
    """Points not older than the retention; a plain filter, so dated partitions are pruned."""
    return points.where(F.col("timestamp") >= hours_before(as_of, hours))


def threshold_alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric values beyond their rule: (metric, threshold, below) decide; 90 and more is critical."""
    hit = F.when(F.col("below"), F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    severity = F.when(F.col("value") < CRITICAL_AT, "warning").otherwise("critical")
    return values.join(rules, "metric").where(hit).withColumn(
        "severity", F.when(F.col("always_critical"), "critical").otherwise(severity)).drop("below", "always_critical")


def cooled_alerts(alerts: DataFrame, minutes: int = COOLDOWN_MINUTES, max_rounds: int = 60) -> DataFrame:
    """First alert of a kind, then the next one more than ``minutes`` later, and so on.

    Each instant points to the first one beyond its cooldown. Starting from the
    first instant of a kind, the set of sent alerts doubles its length per round
    while the pointers are composed with themselves, so a kind of any size is
    spread over all tasks. Of equal instants only the first alert is sent.
    """
    first = cut(alerts.withColumn("us", micros("timestamp")).groupBy("kind", "us").agg(F.min("alert_id").alias("alert_id")))
    jump = cut(first_after(first.select("kind", "us"), ["kind"], "us", minutes * MINUTE_US, "to").where("to IS NOT NULL"))
    sent = cut(first.groupBy("kind").agg(F.min("us").alias("us")))
    for _ in range(max_rounds):
        further = cut(sent.join(jump, ["kind", "us"]).select("kind", F.col("to").alias("us"))
                      .join(sent, ["kind", "us"], "left_anti"))
        if further.isEmpty():
            return first.join(sent, ["kind", "us"], "left_semi").select("kind", "alert_id").join(alerts, ["kind", "alert_id"])
        sent = sent.unionByName(further)
        onward = jump.select("kind", F.col("us").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(onward, ["kind", "to"]).select("kind", "us", F.col("beyond").alias("to")))
    raise RuntimeError("alert chain did not end")


def log_rows(df: DataFrame, event_type: str, fields: Mapping[str, Column], level: str | Column = "INFO",
             timestamp: str = "timestamp") -> DataFrame:
    """Rows of the event log: time, type, level and typed fields as a text map."""
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(F.col(timestamp).alias("timestamp"), F.lit(event_type).alias("event_type"),
                     (F.lit(level) if isinstance(level, str) else level).alias("level"),
                     F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("fields"))


def decision_metrics(decisions: DataFrame) -> DataFrame:
    """Metric points of decisions: the three scores and one count each for level and action."""
    none = F.create_map().cast("map<string,string>")
    points = F.array(
        F.struct(F.lit("hub_risk_score").alias("name"), F.col("hub_risk_score").cast("double").alias("value"), none.alias("labels")),
        F.struct(F.lit("spoke_fraud_score").alias("name"), F.col("spoke_fraud_score").cast("double").alias("value"), none.alias("labels")),
        F.struct(F.lit("final_fraud_score").alias("name"), F.col("final_score").cast("double").alias("value"), none.alias("labels")),
        F.struct(F.lit("fraud_detections_total").alias("name"), F.lit(1.0).alias("value"),
                 F.create_map(F.lit("risk_level"), F.col("risk_level")).alias("labels")),
        F.struct(F.lit("fraud_actions_total").alias("name"), F.lit(1.0).alias("value"),
                 F.create_map(F.lit("action"), F.col("action")).alias("labels")))
    return decisions.select("transaction_id", "timestamp", F.explode(points).alias("p")).select(
        "transaction_id", "timestamp", "p.*")


def latest_fresh(stored: DataFrame, keys: list[str], as_of, ttl_seconds: int = FEATURE_TTL) -> DataFrame:
    """Newest stored row per key that is younger than the time to live."""
    rest = [c for c in stored.columns if c not in keys]
    at = micros(as_time(as_of))
    young = stored.where((micros("computed_at") > at - ttl_seconds * 1_000_000) & (micros("computed_at") <= at))
    newest = young.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("computed_at", *[c for c in rest if c != "computed_at"])).alias("r"))
    return newest.select(*keys, "r.*")


def stale_keys(wanted: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys without a fresh row: the only ones to compute again."""
    return wanted.select(*keys).distinct().join(fresh.select(*keys), keys, "left_anti")


def refresh(stored: DataFrame, wanted: DataFrame, recompute, keys: list[str], as_of, ttl_seconds: int = FEATURE_TTL) -> DataFrame:
    """Fresh rows plus recomputed ones; ``recompute`` gets the stale keys and returns rows like ``stored``."""
    fresh = latest_fresh(stored, keys, as_of, ttl_seconds).join(wanted.select(*keys).distinct(), keys, "left_semi")
    return fresh.unionByName(recompute(stale_keys(wanted, fresh, keys)))


def invalidate(stored: DataFrame, customers: DataFrame, pillar: str | None = None) -> DataFrame:
    """Stored rows without those of the given customers (one pillar, or all)."""
    hit = customers.select("customer_id").distinct()
    if pillar is None:
        return stored.join(hit, "customer_id", "left_anti")
    return stored.join(hit.withColumn("pillar", F.lit(pillar)), ["customer_id", "pillar"], "left_anti")


def drift(base: DataFrame, current: DataFrame, features: Mapping[str, list[float]], limit: float = 0.1) -> DataFrame:
    """Population stability index per feature over given bucket bounds, against a limit."""
    def shares(df: DataFrame, side: str) -> DataFrame:
        # The bucket is the number of bounds at or below the value.
        rows = F.array(*[F.struct(F.lit(f).alias("feature"), sum(
            ((F.col(f) >= float(b)).cast("int") for b in bounds), F.lit(0)).alias("bucket"))
            for f, bounds in features.items()])
        counts = df.select(F.explode(rows).alias("r")).groupBy("r.feature", "r.bucket").agg(F.count(F.lit(1)).alias("n"))
        total = Window.partitionBy("feature")
        return counts.select("feature", "bucket", (F.col("n") / F.sum("n").over(total)).alias(side))

    both = shares(base, "p").join(shares(current, "q"), ["feature", "bucket"], "full_outer")
    p, q = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-6)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-6))
    return both.groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("stability_index")).withColumn(
        "drifted", F.col("stability_index") > limit)
