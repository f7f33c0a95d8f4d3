"""Per-customer online features: grouped streaming state, and the same in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskspark.functions.times import DAY_US, HOUR_US, micros
from riskspark.plans.running import running

# Fixed value: how many recent gaps are kept.
RECENT_GAPS = 100

FEATURES = ["total_transactions", "total_amount", "avg_amount", "amount_std", "days_active", "transactions_per_day",
            "hours_since_last_transaction", "avg_inter_transaction_hours", "std_inter_transaction_hours",
            "median_inter_transaction_hours", "late_rows"]
INTEGERS = {"total_transactions", "days_active", "late_rows"}

STATE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("squares", T.DoubleType()),
    T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()),
    T.StructField("gaps", T.ArrayType(T.DoubleType())), T.StructField("late", T.LongType())])


def output_schema(customer_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("customer_id", customer_type), T.StructField("transaction_id", id_type)] + [
        T.StructField(f, T.LongType() if f in INTEGERS else T.DoubleType()) for f in FEATURES])


def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold the micro-batch rows of one customer into the state, in time order.

    A row older than the newest seen one is late: it counts with a gap of zero.
    """
    rows = pd.concat(list(chunks)).sort_values(["us", "transaction_id"])
    us, amount = rows["us"].to_numpy(np.int64), rows["amount"].to_numpy(np.float64)
    n0, total0, squares0, first, last, gaps, late0 = state.get if state.exists else (0, 0.0, 0.0, None, None, [], 0)
    n = n0 + np.arange(1, len(us) + 1)
    total = np.cumsum(np.concatenate([[total0], amount]))[1:]
    squares = np.cumsum(np.concatenate([[squares0], amount * amount]))[1:]
    # Rows are in time order, so only those before the stored newest row are late.
    newest = np.maximum.accumulate(np.concatenate([[us[0] if last is None else last], us]))
    new_gaps = np.maximum(us - newest[:-1], 0) / HOUR_US
    late = late0 + np.cumsum(us < newest[:-1])
    first = us[0] if first is None else first
    known = np.concatenate([gaps, new_gaps[1:] if last is None else new_gaps])
    mean_gap, std_gap, median_gap = _recent(known, len(gaps), len(us), last is None)
    mean, days = total / n, np.maximum((us - first) // DAY_US, 0)
    out = pd.DataFrame({
        "customer_id": [key[0]] * len(us), "transaction_id": rows["transaction_id"].to_numpy(), "total_transactions": n,
        "total_amount": total, "avg_amount": mean,
        "amount_std": np.where(n > 1, np.sqrt(np.maximum(squares / n - mean * mean, 0.0)), 0.0),
        "days_active": days, "transactions_per_day": n / np.maximum(days, 1), "hours_since_last_transaction": new_gaps,
        "avg_inter_transaction_hours": mean_gap, "std_inter_transaction_hours": std_gap,
        "median_inter_transaction_hours": median_gap, "late_rows": late})
    state.update((int(n[-1]), float(total[-1]), float(squares[-1]), int(first), int(newest[-1]),
                  [float(x) for x in known[-RECENT_GAPS:]], int(late[-1])))
    yield out[["customer_id", "transaction_id", *FEATURES]]


def _recent(known: np.ndarray, before: int, n: int, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and median of the last gaps at each of ``n`` rows.

    ``known`` are the gaps in order, ``before`` of them from earlier batches; the first row of a
    fresh customer has none.
    """
    out = np.zeros((3, n))
    size = before + np.arange(n) + (0 if fresh else 1)
    short = np.flatnonzero((size > 0) & (size < RECENT_GAPS))
    if len(short):
        # Each of these rows sees all gaps before it: one matrix, a row of it per transaction.
        m = size[short]
        inside = np.arange(m[-1]) < m[:, None]
        mean = (inside * known[:m[-1]]).sum(axis=1) / m
        spread = ((inside * (known[:m[-1]] - mean[:, None])) ** 2).sum(axis=1) / m
        ranked, at = np.sort(np.where(inside, known[:m[-1]], np.inf), axis=1), np.arange(len(m))
        out[:, short] = mean, np.sqrt(spread), (ranked[at, (m - 1) // 2] + ranked[at, m // 2]) / 2
    measures = (np.mean, np.std, np.median)
    full = np.flatnonzero(size >= RECENT_GAPS)
    if len(full):
        windows = np.lib.stride_tricks.sliding_window_view(known, RECENT_GAPS)
        for part in np.array_split(full, len(full) // 10_000 + 1):
            out[:, part] = [f(windows[size[part] - RECENT_GAPS], axis=1) for f in measures]
    return out[0], out[1], out[2]


def online_features(stream: DataFrame) -> DataFrame:
    """Streaming transactions to one feature row per transaction, kept per customer."""
    rows = stream.select("customer_id", "transaction_id", micros("timestamp").alias("us"),
                         F.col("amount").cast("double").alias("amount"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.groupBy("customer_id").applyInPandasWithState(
        update, output_schema(kinds["customer_id"], kinds["transaction_id"]), STATE, "append", GroupStateTimeout.NoTimeout)


def online_features_batch(transactions: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """The same features for a stored table.

    Totals are bucketed running sums. For the last gaps a customer's rows are cut
    into chunks by position; the rows just before a chunk travel with it, so a
    window never spans more than one chunk and its short lead.
    """
    amount = F.col("amount").cast("double")
    base = transactions.select("customer_id", "transaction_id", "timestamp", amount.alias("amount"))
    run = running(base, ["customer_id"], "timestamp", ["transaction_id"],
                  sums={"n": F.lit(1).cast("bigint"), "total": F.col("amount"), "squares": F.col("amount") ** 2},
                  lags={"prev": F.col("__us")})
    first = base.groupBy("customer_id").agg(F.min(micros("timestamp")).alias("first_us"))
    run = run.join(first, "customer_id").withColumn("gap", (micros("timestamp") - F.col("prev")) / HOUR_US)
    place = F.col("n") - 1
    chunk = F.floor(place / chunk_rows)
    homes = F.when(place % chunk_rows >= chunk_rows - RECENT_GAPS, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = run.withColumn("home", chunk).withColumn("chunk", F.explode(homes))
    recent = (Window.partitionBy("customer_id", "chunk").orderBy("n").rowsBetween(-(RECENT_GAPS - 1), 0))
    zero = F.lit(0.0)
    spread = spread.withColumns({
        "avg_inter_transaction_hours": F.coalesce(F.avg("gap").over(recent), zero),
        "std_inter_transaction_hours": F.coalesce(F.stddev_pop("gap").over(recent), zero),
        "median_inter_transaction_hours": F.coalesce(F.percentile("gap", 0.5).over(recent), zero)})
    mean = F.col("total") / F.col("n")
    days = F.floor((micros("timestamp") - F.col("first_us")) / DAY_US).cast("bigint")
    variance = F.greatest(F.col("squares") / F.col("n") - mean * mean, zero)
    return spread.where("home = chunk").select(
        "customer_id", "transaction_id", F.col("n").alias("total_transactions"), F.col("total").alias("total_amount"),
        mean.alias("avg_amount"), F.when(F.col("n") > 1, F.sqrt(variance)).otherwise(zero).alias("amount_std"),
        days.alias("days_active"), (F.col("n") / F.greatest(days, F.lit(1))).alias("transactions_per_day"),
        F.coalesce("gap", zero).alias("hours_since_last_transaction"), "avg_inter_transaction_hours",
        "std_inter_transaction_hours", "median_inter_transaction_hours", F.lit(0).cast("bigint").alias("late_rows"))
