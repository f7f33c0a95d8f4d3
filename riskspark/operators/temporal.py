"""Time-series features of every customer and anomaly scores of every transaction."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions import series
from riskspark.functions.quantiles import exact_percentiles
from riskspark.functions.times import DAY_US, HOUR_US, as_time, micros, whole_days
from riskspark.plans.running import asof_sums, running
from riskspark.plans.windowed import distinct_in_windows, windowed

# Window names and minimum sizes.
ROLLING = {"1H": 1, "6H": 6, "24H": 24, "7D": 168, "30D": 720, "90D": 2160}
VELOCITY = ("1H", "6H", "24H", "7D")
MIN_ROWS_PERIOD, MIN_HOURS_PERIOD, MIN_DAYS_SEASON = 10, 24, 30
MIN_ROWS_CHANGE, MIN_DAYS_CHANGE, DRIFT, CHANGE_LIMIT = 20, 5, 0.5, 5.0
MIN_HOURS_WAVELET, BANDS = 32, 5


def until(transactions: DataFrame, as_of) -> DataFrame:
    return transactions.where(F.col("timestamp") <= as_time(as_of))


def gaps(transactions: DataFrame, order: str = "transaction_id") -> DataFrame:
    """Hours since the customer's previous transaction (null on the first)."""
    rows = transactions.select("customer_id", "timestamp", order)
    out = running(rows, ["customer_id"], "timestamp", [order], lags={"__prev": F.col("__us")})
    return out.withColumn("gap_hours", (micros("timestamp") - F.col("__prev")) / HOUR_US).drop("__prev")


def recency_frequency(transactions: DataFrame, as_of) -> DataFrame:
    """Days since first and last, span, rate, and the gap statistics in hours."""
    g = gaps(until(transactions, as_of))
    stats = g.groupBy("customer_id").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"),
        *[F.coalesce(f("gap_hours"), F.lit(0.0)).alias(f"{name}_inter_transaction_hours")
          for name, f in (("avg", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    median = exact_percentiles(g, ["customer_id"], "gap_hours", {"median_inter_transaction_hours": 0.5})
    span = whole_days(F.col("last"), F.col("first"))
    return (stats.join(median, "customer_id", "left")
            .fillna(0.0, ["median_inter_transaction_hours"])
            .withColumns({
                "days_since_first_transaction": whole_days(as_time(as_of), F.col("first")),
                "days_since_last_transaction": whole_days(as_time(as_of), F.col("last")),
                "account_activity_span_days": span,
                "avg_transactions_per_day": F.col("n") / F.greatest(span, F.lit(1))})
            .drop("first", "last", "n"))


def rolling_windows(transactions: DataFrame, as_of, windows: Mapping[str, int] = ROLLING) -> DataFrame:
    """Per window: count, sum, mean, deviation, extremes, distincts, repeat-beneficiary rate."""
    rows = until(transactions, as_of)
    measures = {"{w}_transaction_count": "count(CASE WHEN {in} THEN amount END)"}
    measures |= {f"{{w}}_{name}_amount": f"coalesce({f}(CASE WHEN {{in}} THEN amount END), 0D)" for name, f in (
        ("total", "sum"), ("avg", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))}
    amounts = rows.select("customer_id", "timestamp", F.col("amount").cast("double").alias("amount"))
    sums = windowed(amounts, "customer_id", "timestamp", as_of, windows, measures, clipped=False)
    kinds = {"products": "product_type", "channels": "channel", "beneficiaries": "beneficiary_id"}
    distinct = distinct_in_windows(rows, "customer_id", "timestamp", as_of,
                                   {k: F.col(c) for k, c in kinds.items()}, windows)
    distinct = distinct.select("customer_id", *[F.col(f"{k}_{w}").alias(f"{w}_unique_{k}") for w in windows for k in kinds])
    repeat = [F.expr(f"1 - `{w}_unique_beneficiaries` / greatest(`{w}_transaction_count`, 1L) AS `{w}_repeat_beneficiary_rate`")
              for w in windows]
    return sums.join(distinct, "customer_id", "left").fillna(0).select("*", *repeat)


def velocity_acceleration(rolling: DataFrame) -> DataFrame:
    """Rates per hour and their change between neighbouring windows, from the rolling columns."""
    rates = {w: F.col(f"{w}_transaction_count") / float(ROLLING[w]) for w in VELOCITY}
    return rolling.select(
        "customer_id",
        *[r.alias(f"velocity_txn_per_hour_{w}") for w, r in rates.items()],
        *[(F.col(f"{w}_total_amount") / float(ROLLING[w])).alias(f"velocity_amount_per_hour_{w}") for w in VELOCITY],
        *[(rates[b] - rates[a]).alias(f"acceleration_txn_{a}_to_{b}") for a, b in zip(VELOCITY, VELOCITY[1:])])


def buckets(transactions: DataFrame, unit: str) -> DataFrame:
    """Non-empty time buckets per customer with their count and sum."""
    return (transactions.groupBy("customer_id", F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("double")).alias("total")))


def filled_buckets(transactions: DataFrame, unit: str) -> DataFrame:
    """The same with empty buckets between first and last filled by zero."""
    have = buckets(transactions, unit)
    step = F.expr("INTERVAL 1 HOUR" if unit == "hour" else "INTERVAL 1 DAY")
    grid = (have.groupBy("customer_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
            .select("customer_id", F.explode(F.sequence("a", "b", step)).alias("bucket")))
    return grid.join(have, ["customer_id", "bucket"], "left").fillna(0, ["n", "total"])


def sparse_series(transactions: DataFrame, unit: str) -> DataFrame:
    """Per customer: bucket offsets from the first bucket and their counts, in order.

    The arrays are bounded by the number of time buckets, whatever the row count.
    """
    width = HOUR_US if unit == "hour" else DAY_US
    return (buckets(transactions, unit).groupBy("customer_id")
            .agg(F.array_sort(F.collect_list(F.struct((micros("bucket") / width).cast("bigint").alias("at"), "n"))).alias("s"),
                 F.sum("n").alias("rows"))
            .select("customer_id", "rows",
                    F.transform("s", lambda x: x["at"] - F.col("s")[0]["at"]).alias("offsets"),
                    F.col("s.n").alias("counts")))


@F.pandas_udf(T.StructType([T.StructField("fourier_dominant_period_hours", T.DoubleType()),
                            T.StructField("fourier_power_concentration", T.DoubleType())]))
def _periods(rows: pd.Series, offsets: pd.Series, counts: pd.Series) -> pd.DataFrame:
    out = []
    for n, at, c in zip(rows, offsets, counts):
        if n < MIN_ROWS_PERIOD or at[-1] + 1 < MIN_HOURS_PERIOD:
            out.append((0.0, 0.0))
        else:
            out.append(series.dominant_period(series.dense(at, c)))
    return pd.DataFrame(out, columns=["fourier_dominant_period_hours", "fourier_power_concentration"])


def periodicity(transactions: DataFrame) -> DataFrame:
    """Dominant period of the hourly counts and its share of the power."""
    s = sparse_series(transactions, "hour")
    return s.select("customer_id", _periods("rows", "offsets", "counts").alias("p")).select("customer_id", "p.*")


SEASONAL = ["seasonal_strength", "trend_strength", "remainder_strength", "trend_slope", "seasonal_consistency"]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in SEASONAL]))
def _seasons(offsets: pd.Series, counts: pd.Series) -> pd.DataFrame:
    out = []
    for at, c in zip(offsets, counts):
        values = (0.0,) * 5
        if at[-1] + 1 >= MIN_DAYS_SEASON:
            y = series.dense(at, c)
            if y.var() > 0:
                seasonal, trend = series.seasonal_trend(y)
                rest = y - seasonal - trend
                values = (seasonal.var() / y.var(), trend.var() / y.var(), rest.var() / y.var(),
                          np.polyfit(np.arange(len(y)), trend, 1)[0],
                          1 - seasonal.std() / (np.abs(seasonal).mean() + 1e-8))
        out.append(values)
    return pd.DataFrame(out, columns=SEASONAL)


def seasonality(transactions: DataFrame, method: str = "local") -> DataFrame:
    """Strength of the weekly pattern, the trend and the rest of the daily counts.

    ``local`` decomposes by local regression, ``classical`` by moving averages in
    plain windows over the few daily buckets of a customer.
    """
    if method == "local":
        s = sparse_series(transactions, "day")
        return s.select("customer_id", _seasons("offsets", "counts").alias("p")).select("customer_id", "p.*")
    return _classical(transactions)


def _classical(transactions: DataFrame) -> DataFrame:
    by_day = Window.partitionBy("customer_id").orderBy("bucket")
    near = by_day.rowsBetween(-3, 3)
    d = filled_buckets(transactions, "day").withColumns({
        "t": F.row_number().over(by_day) - 1, "x": F.col("n").cast("double"),
        "days": F.count(F.lit(1)).over(Window.partitionBy("customer_id"))})
    d = d.where(F.col("days") >= MIN_DAYS_SEASON).withColumn(
        "trend", F.when(F.count(F.lit(1)).over(near) == 7, F.avg("x").over(near)))
    position = Window.partitionBy("customer_id", F.col("t") % 7)
    d = d.withColumn("raw", F.avg(F.col("x") - F.col("trend")).over(position))
    d = d.withColumn("seasonal", F.col("raw") - F.avg("raw").over(Window.partitionBy("customer_id")))
    d = d.withColumn("rest", F.col("x") - F.col("trend") - F.col("seasonal"))
    variance = F.var_pop("x")

    def share(e: Column) -> Column:
        return F.when(variance > 0, e / variance).otherwise(0.0)

    return d.groupBy("customer_id").agg(
        share(F.var_pop("seasonal")).alias("seasonal_strength"),
        share(F.var_pop("trend")).alias("trend_strength"),
        share(F.var_pop("rest")).alias("remainder_strength"),
        F.regr_slope("trend", "t").alias("trend_slope"),
        (1 - F.stddev_pop("seasonal") / (F.avg(F.abs("seasonal")) + 1e-8)).alias("seasonal_consistency"))


def change_points(transactions: DataFrame) -> DataFrame:
    """Two-sided cumulative-sum change points of the daily totals.

    Each arm is a prefix sum minus its running minimum (or maximum), so plain
    windows over a customer's days suffice.
    """
    by_day = Window.partitionBy("customer_id").orderBy("bucket")
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("customer_id")
    d = filled_buckets(transactions, "day").withColumns({
        "t": F.row_number().over(by_day) - 1, "days": F.count(F.lit(1)).over(whole),
        "rows": F.sum("n").over(whole), "mean": F.avg("total").over(whole)})
    shift = F.col("total") - F.col("mean")
    d = d.withColumns({
        "p": F.sum(F.when(F.col("t") > 0, shift - DRIFT).otherwise(0.0)).over(upto),
        "q": F.sum(F.when(F.col("t") > 0, shift + DRIFT).otherwise(0.0)).over(upto)})
    d = d.withColumns({"up": F.col("p") - F.min("p").over(upto), "down": F.max("q").over(upto) - F.col("q")})
    hit = ((F.col("t") >= 1) & (F.col("t") <= F.col("days") - 2) & (F.col("days") >= MIN_DAYS_CHANGE)
           & ((F.col("up") > CHANGE_LIMIT) | (F.col("down") > CHANGE_LIMIT)))
    out = d.groupBy("customer_id").agg(
        F.count_if(hit).alias("hits"), F.max(F.when(hit, F.col("t"))).alias("last"),
        F.first("days").alias("days"), F.first("rows").alias("rows"))
    enough = F.col("rows") >= MIN_ROWS_CHANGE
    return out.select(
        "customer_id", F.when(enough, F.col("hits")).otherwise(0).cast("bigint").alias("changepoints_detected"),
        F.when(enough, F.when(F.col("hits") > 0, F.col("days") - 1 - F.col("last")).otherwise(F.col("days")))
        .otherwise(0).cast("bigint").alias("time_since_last_changepoint_days"))


WAVELET = [f"wavelet_{m}_level_{i}" for i in range(BANDS) for m in ("energy", "std", "max", "energy_ratio")]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in WAVELET]))
def _wavelets(offsets: pd.Series, counts: pd.Series) -> pd.DataFrame:
    out = []
    for at, c in zip(offsets, counts):
        if at[-1] + 1 < MIN_HOURS_WAVELET:
            out.append([0.0] * len(WAVELET))
            continue
        bands = series.wavelet_bands(series.dense(at, c))
        energy = [float((b ** 2).sum()) for b in bands]
        out.append([v for b, e in zip(bands, energy)
                    for v in (e, float(b.std()), float(np.abs(b).max()), e / (sum(energy) + 1e-8))])
    return pd.DataFrame(out, columns=WAVELET)


def wavelets(transactions: DataFrame) -> DataFrame:
    """Energy, deviation, largest coefficient and energy share of five bands."""
    s = sparse_series(transactions, "hour")
    return s.select("customer_id", _wavelets("offsets", "counts").alias("p")).select("customer_id", "p.*")


def habits(transactions: DataFrame) -> DataFrame:
    """Business-hour and weekend shares, entropy over hours, busiest hour."""
    ts = F.col("timestamp")
    hours = transactions.groupBy("customer_id", F.hour(ts).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.weekday(ts) >= 5).alias("weekend"))
    totals = Window.partitionBy("customer_id")
    share = F.col("n") / F.sum("n").over(totals)
    marked = hours.withColumn("term", share * F.log2(share + 1e-8))
    total = F.sum("n")
    business = F.sum(F.when(F.col("h").between(9, 17), F.col("n")).otherwise(0)) / total
    return marked.groupBy("customer_id").agg(
        business.alias("business_hours_ratio"), (1 - business).alias("non_business_hours_ratio"),
        (F.sum("weekend") / total).alias("weekend_ratio"), (1 - F.sum("weekend") / total).alias("weekday_ratio"),
        (-F.sum("term")).alias("hour_entropy"),
        F.max_by("h", F.struct(F.col("n"), -F.col("h"))).alias("most_active_hour"),
        F.max("n").alias("most_active_hour_count"))


def temporal_features(customers: DataFrame, transactions: DataFrame, as_of, native_only: bool = False) -> DataFrame:
    """All time-series columns for all customers, zero where data is missing or too short."""
    rows = until(transactions, as_of)
    rolling = rolling_windows(transactions, as_of)
    parts = [recency_frequency(transactions, as_of), rolling, velocity_acceleration(rolling),
             change_points(rows), habits(rows)]
    if not native_only:
        parts += [periodicity(rows), seasonality(rows), wavelets(rows)]
    out = customers.select("customer_id")
    for p in parts:
        out = out.join(p, "customer_id", "left")
    return out.fillna(0)


def hour_history(history: DataFrame) -> DataFrame:
    return history.groupBy("customer_id", F.hour("timestamp").alias("h")).agg(
        F.count(F.lit(1)).alias("hour_n"), F.avg(F.col("amount").cast("double")).alias("hour_mean"),
        F.stddev_samp(F.col("amount").cast("double")).alias("hour_std"))


def trailing_counts(rows: DataFrame, hours: int = 24, history: DataFrame | None = None) -> DataFrame:
    """Per transaction: the customer's history rows in the ``hours`` up to and including it.

    Running counts at the row time and just before the window start are
    subtracted; probes and events share one bucketed union.
    """
    events = (history if history is not None else rows).select("customer_id", micros("timestamp").alias("us"))
    ends = F.array(F.struct(F.lit(0).cast("bigint").alias("back"), F.lit(True).alias("inclusive"), F.lit(1).alias("sign")),
                   F.struct(F.lit(hours * HOUR_US).alias("back"), F.lit(False).alias("inclusive"), F.lit(-1).alias("sign")))
    probes = (rows.select("customer_id", "transaction_id", micros("timestamp").alias("us"), F.explode(ends).alias("p"))
              .select("customer_id", "transaction_id", (F.col("us") - F.col("p.back")).alias("at"),
                      F.col("p.inclusive").alias("inclusive"), F.col("p.sign").alias("sign")))
    counted = asof_sums(events, probes, ["customer_id"], event_us="us", probe_us="at", inclusive="inclusive",
                        sums={"n": F.lit(1).cast("bigint")})
    return counted.groupBy("transaction_id", "customer_id").agg(F.sum(F.col("n") * F.col("sign")).alias("trailing"))


def temporal_anomalies(transactions: DataFrame, history: DataFrame) -> DataFrame:
    """Hour, frequency and amount-at-hour anomaly scores on one row per transaction."""
    hours = hour_history(history)
    sizes = hours.groupBy("customer_id").agg(F.sum("hour_n").alias("rows"))
    own = trailing_counts(history)
    base = own.groupBy("customer_id").agg(F.avg("trailing").alias("mean_trailing"),
                                          F.stddev_pop("trailing").alias("std_trailing"))
    # A row that the history does not hold yet counts itself.
    stored = history.select("transaction_id", F.lit(0).alias("new")).distinct()
    now = (trailing_counts(transactions, history=history).join(stored, "transaction_id", "left")
           .select("transaction_id", (F.col("trailing") + F.coalesce("new", F.lit(1))).alias("trailing")))
    t = (transactions.select("transaction_id", "customer_id", F.hour("timestamp").alias("h"),
                             F.col("amount").cast("double").alias("amount"))
         .join(sizes, "customer_id", "left").join(base, "customer_id", "left")
         .join(hours, ["customer_id", "h"], "left").join(now, "transaction_id", "left"))
    rows = F.coalesce("rows", F.lit(0))
    seen = F.coalesce("hour_n", F.lit(0))
    z_count = F.abs(F.col("trailing") - F.col("mean_trailing")) / F.col("std_trailing")
    z_amount = F.abs(F.col("amount") - F.col("hour_mean")) / F.col("hour_std")
    return t.select(
        "transaction_id",
        F.when(rows < 5, 0.0).otherwise(1 - seen / rows).alias("time_of_day_anomaly_score"),
        F.when((rows < 10) | ~(F.col("std_trailing") > 0), 0.0)
        .otherwise(F.least(z_count / 3, F.lit(1.0))).alias("frequency_anomaly_score"),
        F.when(rows < 10, 0.0).when(seen == 0, 1.0)
        .when(F.col("hour_std") > 0, F.least(z_amount / 3, F.lit(1.0)))
        .when(F.col("amount") == F.col("hour_mean"), 0.0).otherwise(1.0).alias("amount_timing_anomaly_score"))
