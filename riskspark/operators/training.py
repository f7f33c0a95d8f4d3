"""Training sets: labels joined to features as they were at labelling time."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.times import HOUR_US, WINDOW_HOURS, as_time, micros
from riskspark.operators import point_in_time
from riskspark.plans.fixpoint import cut
from riskspark.plans.running import asof_sums

# Label window in days, least label confidence.
LABEL_DAYS, MIN_CONFIDENCE = 730, 0.8


def confident_labels(labels: DataFrame, as_of) -> DataFrame:
    start = as_time(as_of) - F.make_dt_interval(F.lit(LABEL_DAYS))
    return labels.where((F.col("confidence_score") >= MIN_CONFIDENCE) & (F.col("label_timestamp") >= start))


def labelled_transactions(transactions: DataFrame, labels: DataFrame, as_of, product: str | None = None) -> DataFrame:
    """Transactions with a confident label, of one product if given."""
    rows = transactions if product is None else transactions.where(F.col("product_type") == product)
    kept = confident_labels(labels, as_of).select("transaction_id", "is_fraud", "label_timestamp")
    return rows.join(kept, "transaction_id")


def customer_labels(labels: DataFrame, as_of) -> DataFrame:
    """Distinct (customer, label, time) of confident labels."""
    return confident_labels(labels, as_of).select("customer_id", "is_fraud", "label_timestamp").distinct()


def point_in_time_windows(labels: DataFrame, transactions: DataFrame,
                          windows: Mapping[str, int] = WINDOW_HOURS) -> DataFrame:
    """Approved count, volume and mean per window, each ending at the label's own time.

    Every label asks for running sums at its time and at each window start; a
    window is the difference. Labels and transactions meet in one bucketed
    union instead of a range join.
    """
    keys = ["customer_id", "is_fraud", "label_timestamp"]
    events = transactions.where("status = 'approved'").select(
        "customer_id", micros("timestamp").alias("us"), F.col("amount").cast("double").alias("amount"))
    asked = F.array(F.struct(F.lit("end").alias("name"), F.lit(0).cast("bigint").alias("back"), F.lit(True).alias("inclusive")),
                    *[F.struct(F.lit(w).alias("name"), F.lit(h * HOUR_US).cast("bigint").alias("back"),
                               F.lit(False).alias("inclusive")) for w, h in windows.items()])
    probes = labels.select(*keys, F.explode(asked).alias("p")).select(
        *keys, "p.name", (micros("label_timestamp") - F.col("p.back")).alias("at"), F.col("p.inclusive").alias("inclusive"))
    sums = asof_sums(events, probes, ["customer_id"], event_us="us", probe_us="at", inclusive="inclusive",
                     sums={"n": F.lit(1).cast("bigint"), "volume": F.col("amount")})

    def at(name: str, value: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(value)))

    wide = sums.groupBy(*keys).agg(*[at(x, v).alias(f"{v}_{x}") for x in ("end", *windows) for v in ("n", "volume")])
    out = []
    for w in windows:
        count = F.col("n_end") - F.col(f"n_{w}")
        volume = F.when(count > 0, F.col("volume_end") - F.col(f"volume_{w}")).otherwise(0.0)
        out += [count.alias(f"transaction_count_{w}"), volume.alias(f"transaction_volume_{w}"),
                F.when(count > 0, volume / count).otherwise(0.0).alias(f"avg_transaction_amount_{w}")]
    return wide.select(*keys, *out)


def hub_training_set(labels: DataFrame, inputs, as_of) -> DataFrame:
    """Every confident label with its customer's profile, activity and own network edges as they were just
    before it. ``inputs``: the tables of ``registry.Inputs``."""
    keys = ["customer_id", "is_fraud", "label_timestamp"]
    probes = cut(customer_labels(labels, as_of).withColumn("us", micros("label_timestamp")))
    activity = point_in_time.activity_before(probes, keys, inputs.transactions, inputs.events, inputs.fraud_records)
    who = point_in_time.profile_before(probes, keys, "label_timestamp", inputs.customers, inputs.products, inputs.risk)
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return who.alias("a").join(activity.alias("b"), same).select(
        "a.*", *[f"b.{c}" for c in activity.columns if c not in keys])


def attach_hub_score(transactions: DataFrame, hub_scores: DataFrame, default: float = 0.5) -> DataFrame:
    """Each transaction with the risk score of its customer."""
    return transactions.join(hub_scores.select("customer_id", "hub_score"), "customer_id", "left").fillna(
        default, ["hub_score"])


def new_beneficiary(transactions: DataFrame, history: DataFrame, product: str = "pix") -> DataFrame:
    """1 unless the customer paid this beneficiary by the same product strictly earlier."""
    return with_new_beneficiary(transactions, history, product).select("transaction_id", "is_new_beneficiary")


def with_new_beneficiary(transactions: DataFrame, history: DataFrame, product: str = "pix") -> DataFrame:
    """``transactions`` with the new-beneficiary flag."""
    pair = ["customer_id", "beneficiary_id"]
    first = (history.where((F.col("product_type") == product) & F.col("beneficiary_id").isNotNull())
             .groupBy(*pair).agg(F.min("timestamp").alias("__first")))
    return transactions.join(first, pair, "left").select(
        *transactions.columns, F.when(F.col("__first") < F.col("timestamp"), 0).otherwise(1).alias("is_new_beneficiary"))


def stable_fraction(id_column: str, seed: int = 42) -> Column:
    """A number in [0, 1) fixed by the id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(16 ** 8))


def _id_key(df: DataFrame, id_column: str) -> Column:
    """The order of rows of one instant: the id if it is a whole number, otherwise its hash."""
    whole = dict(df.dtypes)[id_column] in ("tinyint", "smallint", "int", "bigint")
    return F.col(id_column).cast("bigint") if whole else F.xxhash64(id_column)


def time_boundary(df: DataFrame, ts: str, id_column: str, rank: int):
    """(microseconds, id) of the row at position ``rank`` (from 1) by time and id, or None beyond the end.

    Found from counts: per hour, then per second of the hour that holds the
    position, then per microsecond of that second, then per stretch of the
    ids (or their hashes) of that instant. No row is ranked; each step sorts a bounded number of counts.
    """
    rows, left = cut(df.select(micros(ts).alias("us"), _id_key(df, id_column).alias("id"))), rank
    for bucket in (*[F.floor(F.col("us") / width) for width in (HOUR_US, 1_000_000, 1)],
                   *[F.shiftright("id", bits) for bits in (44, 22, 0)]):
        counts = rows.groupBy(bucket.cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        found = (counts.withColumn("before", F.coalesce(before, F.lit(0)))
                 .where((F.col("before") < left) & (F.col("before") + F.col("n") >= left)).first())
        if found is None:
            return None
        rows, left = rows.where(bucket.cast("bigint") == found["b"]), left - found["before"]
    at = rows.first()
    return at["us"], at["id"]


def _after(df: DataFrame, ts: str, id_column: str, boundary) -> Column:
    """Whether a row lies at or behind a boundary."""
    if boundary is None:
        return F.lit(False)
    us = micros(ts)
    return (us > boundary[0]) | ((us == boundary[0]) & (_id_key(df, id_column) >= F.lit(boundary[1])))


def split_by_time(df: DataFrame, ts: str, id_column: str, test: float = 0.1, validation: float = 0.2,
                  seed: int = 42) -> DataFrame:
    """Column ``part``: the last rows by time are ``test``; of the others a stable share is ``validation``.

    The share depends only on the id, so it is the same within each class.
    """
    boundary = time_boundary(df, ts, id_column, math.floor(df.count() * (1 - test)) + 1)
    part = (F.when(_after(df, ts, id_column, boundary), "test")
            .when(stable_fraction(id_column, seed) < validation, "validation").otherwise("train"))
    return df.withColumn("part", part)


def time_folds(df: DataFrame, ts: str, id_column: str, folds: int = 3) -> DataFrame:
    """Column ``block`` 0..folds in time order: train on blocks up to i, test on i + 1."""
    size = df.count()
    block = F.lit(0)
    for b in range(1, folds + 1):
        start = time_boundary(df, ts, id_column, -(-b * size // (folds + 1)) + 1)
        block = F.when(_after(df, ts, id_column, start), b).otherwise(block)
    return df.withColumn("block", block.cast("int"))
