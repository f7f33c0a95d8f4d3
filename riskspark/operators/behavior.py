"""Behavioural features: trailing-window activity of every customer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.times import WINDOW_HOURS
from riskspark.plans.windowed import distinct_in_windows, windowed


def transaction_windows(transactions: DataFrame, as_of,
                        windows: Mapping[str, int] = WINDOW_HOURS) -> DataFrame:
    """Approved transactions per window: count, volume, mean, sample deviation."""
    rows = transactions.where(F.col("status") == "approved").select(
        "customer_id", "timestamp", F.col("amount").cast("double").alias("amount"))
    return windowed(rows, "customer_id", "timestamp", as_of, windows, {
        "transaction_count": "count(CASE WHEN {in} THEN amount END)",
        "transaction_volume": "coalesce(sum(CASE WHEN {in} THEN amount END), 0D)",
        "avg_transaction_amount": "coalesce(avg(CASE WHEN {in} THEN amount END), 0D)",
        "std_transaction_amount": "coalesce(stddev_samp(CASE WHEN {in} THEN amount END), 0D)"})


def transaction_diversity(transactions: DataFrame, as_of,
                          windows: Mapping[str, int] = WINDOW_HOURS) -> DataFrame:
    """Distinct products and days (approved), channels, devices and addresses (any status)."""
    approved = F.col("status") == "approved"
    return distinct_in_windows(transactions, "customer_id", "timestamp", as_of, {
        "products_used": F.when(approved, F.col("product_type")),
        "active_days": F.when(approved, F.to_date("timestamp")),
        "channels_used": F.col("channel"),
        "devices_used": F.col("device_id"),
        "ips_used": F.col("ip_address"),
    }, windows)


def channel_counts(transactions: DataFrame, as_of,
                   windows: Mapping[str, int] = WINDOW_HOURS) -> DataFrame:
    """Transactions per channel and window, any status."""
    names = {"mobile": "mobile_app", "web": "web_browser", "atm": "atm"}
    return windowed(transactions.select("customer_id", "timestamp", "channel"), "customer_id", "timestamp", as_of, windows, {
        f"{short}_transactions": f"count_if({{in}} AND channel = '{channel}')" for short, channel in names.items()})


def digital_activity(events: DataFrame, as_of,
                     windows: Mapping[str, int] = WINDOW_HOURS) -> DataFrame:
    """App and web activity per window.

    Distinct hours are a bit mask, so no set of values is kept for them.
    """
    counts = windowed(events, "customer_id", "timestamp", as_of, windows, {
        "login_count": "count_if({in})",
        "avg_session_duration": "coalesce(avg(CASE WHEN {in} THEN session_duration_minutes END), 0D)",
        "password_changes": "count_if({in} AND event_type = 'password_change')",
        "profile_updates": "count_if({in} AND event_type = 'profile_update')",
        "active_hours": "coalesce(cast(bit_count(bit_or(CASE WHEN {in} THEN shiftleft(1, hour(timestamp)) END)) AS bigint), 0L)"})
    days = distinct_in_windows(events, "customer_id", "timestamp", as_of,
                               {"login_days": F.to_date("timestamp")}, windows)
    return counts.join(days, "customer_id", "left")


def velocity(features: DataFrame, windows=("1h", "6h", "24h")) -> DataFrame:
    """Per-hour rates derived from the window columns; no second scan."""
    rates = [F.expr(f"{source}_{w} / {float(WINDOW_HOURS[w])}D AS {name}_{w}") for w in windows
             for name, source in (("transaction_velocity", "transaction_count"), ("volume_velocity", "transaction_volume"))]
    return features.select("*", *rates)


def behavioral_features(transactions: DataFrame, events: DataFrame, as_of,
                        windows: Mapping[str, int] = WINDOW_HOURS) -> DataFrame:
    """The whole behavioural pillar, one row per customer seen in either table."""
    parts = [transaction_diversity(transactions, as_of, windows),
             channel_counts(transactions, as_of, windows),
             transaction_windows(transactions, as_of, windows),
             digital_activity(events, as_of, windows)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "customer_id", "full_outer")
    filled = out.fillna(0)
    return velocity(filled, [w for w in ("1h", "6h", "24h") if w in windows])
