"""Decisions: combined score, level, action, reasons, safe defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights, boost and damping rules, thresholds, actions, reasons.
HUB_WEIGHT, SPOKE_WEIGHT = 0.4, 0.6
BOTH_HIGH, BOOST = 0.7, 1.2
HUB_LOW, SPOKE_HIGH, DAMP = 0.2, 0.8, 0.8
LEVELS = ("low", "medium", "high", "critical")
ACTIONS = {"low": "approve", "medium": "challenge", "high": "reject", "critical": "reject"}
UNKNOWN_ACTION = "manual_review"
SAFE_SCORE = 0.5
ERROR_REASONS = ("SYSTEM_ERROR", "MANUAL_REVIEW_REQUIRED")
MAX_REASONS = 5


@dataclass(frozen=True)
class Thresholds:
    low: float = 0.2
    medium: float = 0.5
    high: float = 0.8


def combined_score(hub: Column, spoke: Column) -> Column:
    blend = hub * HUB_WEIGHT + spoke * SPOKE_WEIGHT
    adjusted = (F.when((hub > BOTH_HIGH) & (spoke > BOTH_HIGH), F.least(F.lit(1.0), blend * BOOST))
                .when((hub < HUB_LOW) & (spoke > SPOKE_HIGH), blend * DAMP)
                .otherwise(blend))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), adjusted))


def risk_level(score: Column, product: Column,
               thresholds: Mapping[str, Thresholds] | None = None) -> Column:
    """Level by the thresholds of the product; anything below medium is low."""
    def level(t: Thresholds) -> Column:
        return F.when(score >= t.high, "high").when(score >= t.medium, "medium").otherwise("low")

    out = level((thresholds or {}).get("default", Thresholds()))
    for name, t in (thresholds or {}).items():
        if name != "default":
            out = F.when(product == name, level(t)).otherwise(out)
    return out


def risk_action(level: Column) -> Column:
    out = F.lit(UNKNOWN_ACTION)
    for name, action in ACTIONS.items():
        out = F.when(level == name, F.lit(action)).otherwise(out)
    return out


def reason_codes(level: Column, hub: Column, spoke: Column, columns: set[str]) -> Column:
    """First five of nine ordered rules; a rule whose feature column is absent stays silent."""
    def feature(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("double")

    # Rule order, limits and codes.
    rules = [
        (level == "high", "HIGH_RISK_TRANSACTION"),
        (hub > 0.7, "HIGH_CUSTOMER_RISK_PROFILE"),
        (spoke > 0.7, "SUSPICIOUS_TRANSACTION_PATTERN"),
        (feature("is_night_transaction") == 1, "UNUSUAL_TIME_OF_DAY"),
        (feature("distance_from_usual_location_km") > 100, "UNUSUAL_LOCATION"),
        (feature("amount_zscore") > 2, "UNUSUAL_AMOUNT"),
        (feature("is_new_beneficiary") == 1, "NEW_BENEFICIARY"),
        (feature("fraudulent_beneficiaries_count") > 0, "RISKY_BENEFICIARY_NETWORK"),
        (feature("customers_sharing_devices") > 5, "SHARED_DEVICE_RISK"),
    ]
    found = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in rules]))
    return F.slice(found, 1, MAX_REASONS)


# The wording of an explanation.
def explanation(hub: Column, spoke: Column, final: Column, factors: list[str]) -> Column:
    return F.struct(
        F.format_string("Customer risk level: %.2f, Transaction risk: %.2f", hub, spoke).alias("summary"),
        F.format_string("%.3f (40%% weight)", hub * HUB_WEIGHT).alias("hub_model_contribution"),
        F.format_string("%.3f (60%% weight)", spoke * SPOKE_WEIGHT).alias("spoke_model_contribution"),
        F.format_string("Final score: %.3f", final).alias("final_score_calculation"),
        F.array(*[F.lit(f) for f in factors[:3]]).cast("array<string>").alias("key_risk_factors"))


def decide(scored: DataFrame, thresholds: Mapping[str, Thresholds] | None = None,
           factors: list[str] | None = None, with_explanation: bool = True) -> DataFrame:
    """Decision columns for rows carrying ``hub_score``, ``spoke_score`` and ``product_type``.

    A row without a usable score takes the safe default and goes to manual review.
    """
    def usable(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.isnan(name)

    failed = ~(usable("hub_score") & usable("spoke_score"))
    hub, spoke = F.col("hub_risk_score"), F.col("spoke_fraud_score")
    names = set(scored.columns)
    out = scored.withColumns({
        "__failed": failed,
        "hub_risk_score": F.when(failed, SAFE_SCORE).otherwise(F.col("hub_score")),
        "spoke_fraud_score": F.when(failed, SAFE_SCORE).otherwise(F.col("spoke_score"))})
    out = out.withColumn("final_score", F.when(F.col("__failed"), SAFE_SCORE)
                         .otherwise(combined_score(hub, spoke)))
    out = out.withColumn("risk_level", F.when(F.col("__failed"), "medium")
                         .otherwise(risk_level(F.col("final_score"), F.col("product_type"), thresholds)))
    final, level = F.col("final_score"), F.col("risk_level")
    columns = {
        "action": F.when(F.col("__failed"), UNKNOWN_ACTION).otherwise(risk_action(level)),
        "reason_codes": F.when(F.col("__failed"), F.array(*map(F.lit, ERROR_REASONS)))
        .otherwise(reason_codes(level, hub, spoke, names)),
        "predicted_class": F.when(F.col("__failed"), "unknown")
        .when(final > 0.5, "fraud").otherwise("legitimate"),
        "confidence": F.when(F.col("__failed"), 0.0).otherwise(F.greatest(final, 1 - final)),
    }
    if with_explanation:
        columns["explanation"] = explanation(hub, spoke, final, factors or [])
    return out.withColumns(columns).drop("__failed")


def high_risk_alerts(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("risk_level").isin("high", "critical"))


def decision_distribution(decisions: DataFrame) -> DataFrame:
    """Count and share per level and action; the window sees one row per combination."""
    from pyspark.sql import Window
    counts = decisions.groupBy("risk_level", "action").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def prediction_log(decisions: DataFrame, model_versions: Mapping[str, str], at) -> DataFrame:
    """The eleven columns of the prediction log, versions as JSON text."""
    from riskspark.functions.times import as_time
    versions = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in model_versions.items()]))
    processing = F.col("processing_time_ms") if "processing_time_ms" in decisions.columns \
        else F.lit(None).cast("double")
    return decisions.select(
        "transaction_id", "customer_id", "product_type",
        F.col("hub_risk_score").alias("hub_score"), F.col("spoke_fraud_score").alias("spoke_score"),
        "final_score", "risk_level", "action", processing.alias("processing_time_ms"),
        as_time(at).alias("timestamp"), versions.alias("model_versions"))
