"""Streaming queries: run to the end of the available data, then read what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskspark.catalog.base import query, rounded
from riskspark.catalog.features import SAME_DAY
from riskspark.catalog.models import NEW_BENEFICIARY, Stage
from riskspark.operators import context, training
from riskspark.session import ensure_checkpoint_dir
from riskspark.streaming import flows, online

ONLINE = """
WITH g AS (SELECT customer_id, transaction_id, timestamp, amount, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 3600000000 AS gap,
    count(*) OVER w AS n, sum(amount) OVER w AS total, sum(amount * amount) OVER w AS sq, min(timestamp) OVER w AS a
  FROM tx WINDOW w AS (PARTITION BY customer_id ORDER BY timestamp, transaction_id)),
h AS (SELECT *, avg(gap) OVER r AS ga, stddev_pop(gap) OVER r AS gs, quantile_cont(gap, 0.5) OVER r AS gm,
    (epoch_us(timestamp) - epoch_us(a)) // 86400000000 AS days FROM g
  WINDOW r AS (PARTITION BY customer_id ORDER BY timestamp, transaction_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT customer_id, transaction_id, n AS total_transactions, round(total, 4) AS total_amount, round(total / n, 4) AS avg_amount,
  round(CASE WHEN n > 1 THEN sqrt(greatest(sq / n - (total / n) * (total / n), 0)) ELSE 0 END, 4) AS amount_std, days AS days_active,
  round(n / greatest(days, 1), 4) AS transactions_per_day, round(coalesce(gap, 0), 4) AS hours_since_last_transaction,
  round(coalesce(ga, 0), 4) AS avg_inter_transaction_hours, round(coalesce(gs, 0), 4) AS std_inter_transaction_hours,
  round(coalesce(gm, 0), 4) AS median_inter_transaction_hours, CAST(0 AS BIGINT) AS late_rows FROM h"""


def scratch(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def run(t, stream, name: str, transform=lambda df: df, output_mode: str = "append"):
    flows.use_rocksdb(t.spark)
    place = scratch(t, name)
    q = flows.write_batches(stream, transform, f"{place}/out", f"{place}/state", output_mode)
    q.awaitTermination()
    return t.spark.read.parquet(f"{place}/out")


@query("online_features_batch", ONLINE, "tx")
def online_features_batch(t):
    """Running totals and the statistics of the last hundred gaps, per transaction."""
    return rounded(online.online_features_batch(t.transactions()))


@query("online_features_stream", ONLINE, "tx")
def online_features_stream(t):
    """The same from grouped streaming state."""
    out = run(t, online.online_features(t.as_stream().transactions()), "online")
    return rounded(out.drop("batch_id"))


@query("stream_transactions", "SELECT transaction_id, customer_id, product_type, round(amount, 4) AS amount FROM tx", "tx")
def stream_transactions(t):
    """File stream source with a fixed schema."""
    out = run(t, t.as_stream().transactions().select("transaction_id", "customer_id", "product_type", "amount"), "source")
    return rounded(out.drop("batch_id"))


@query("trailing_activity_stream", """
SELECT customer_id, time_bucket(INTERVAL 1 HOUR, timestamp) + to_hours(1 - CAST(o AS INTEGER)) - INTERVAL 1 HOUR AS window_start,
  time_bucket(INTERVAL 1 HOUR, timestamp) + to_hours(1 - CAST(o AS INTEGER)) + INTERVAL 23 HOUR AS window_end, count(*) AS transactions, round(sum(amount), 4) AS volume
FROM tx, range(0, 24) r(o) GROUP BY 1, 2, 3""", "tx")
def trailing_activity_stream(t):
    """Sliding 24-hour activity; the last state of every window after all data was read."""
    out = run(t, flows.activity_parts(t.as_stream().transactions()), "trailing", output_mode="update")
    return rounded(flows.trailing_activity(out))


@query("stream_context", f"""
SELECT transaction_id, transactions_today, minutes_since_last_transaction, is_new_beneficiary
FROM ({SAME_DAY}) JOIN ({NEW_BENEFICIARY}) USING (transaction_id)""", "tx")
def stream_context(t):
    """What a row's earlier rows tell, from a stream that has no other history than itself; the rows held back are settled at the end."""
    place = scratch(t, "context")
    tx = t.transactions()

    def decision(rows, known):
        return training.with_new_beneficiary(context.with_same_day(rows, known), known)

    none = tx.where(F.lit(False))
    flows.decide_with_history(t.as_stream().transactions(), decision, none, f"{place}/out", f"{place}/state", "1 hour").awaitTermination()
    flows.finish(tx, decision, none, f"{place}/out", "1 hour")
    return t.spark.read.parquet(f"{place}/out").select(
        "transaction_id", *context.SAME_DAY_COLUMNS, "is_new_beneficiary")


@query("stream_decisions")
def stream_decisions(t):
    """Micro-batches scored, decided and logged through the batch path."""
    place = scratch(t, "decisions")
    scorer = Stage.of(t).scorer(t)
    q = flows.decide_stream(t.as_stream().transactions(), scorer, f"{place}/out", f"{place}/state", f"{place}/alerts")
    q.awaitTermination()
    out = t.spark.read.parquet(f"{place}/out")
    return rounded(out.select("transaction_id", "final_score", "risk_level", "action"))
