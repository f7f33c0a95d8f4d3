"""Modelling table: rule features, customer history and demo summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.quantiles import exact_percentiles
from riskspark.operators.context import is_night

# Product risk, device risk, segment and base-risk limits, card categories,
# loan placeholders.
PRODUCT_RISK = {"PIX": 0.7, "TED": 0.5, "DOC": 0.3, "DEBIT": 0.2}
PRODUCT_RISK_ELSE = 0.5
DEVICE_RISK_ABOVE, DEVICE_RISK_HIGH, DEVICE_RISK_LOW = 9000, 0.8, 0.2
MERCHANT_CODES = {"5411": 1, "5541": 2, "5812": 3, "5999": 4}
HIGH_RISK_MERCHANTS = ("5812", "5813", "7995", "5933")
LOAN_DEFAULTS = {"loan_purpose_encoded": 1, "debt_to_income_ratio": 0.3,
                 "employment_stability_score": 0.8, "collateral_value_ratio": 1.2,
                 "interest_rate": 0.15}


def lookup(column: Column, table: Mapping[str, float], default) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def product_risk(product: Column) -> Column:
    return lookup(F.upper(product), PRODUCT_RISK, PRODUCT_RISK_ELSE)


def device_risk(device: Column) -> Column:
    number = F.get(F.split(device, "_"), 1).try_cast("bigint")
    return F.when(number > DEVICE_RISK_ABOVE, DEVICE_RISK_HIGH).otherwise(DEVICE_RISK_LOW)


def segment(income: Column, credit: Column) -> Column:
    return (F.when((income >= 100000) & (credit >= 750), "premium")
            .when((income >= 50000) & (credit >= 650), "standard").otherwise("basic"))


def base_risk(age: Column, income: Column, credit: Column, is_pep: Column) -> Column:
    """Sum of increments for age, income, credit score and exposure, at most 1."""
    total = (F.when((age < 25) | (age > 70), 0.2).otherwise(0.0)
             + F.when(income < 30000, 0.3).otherwise(0.0)
             + F.when(credit < 600, 0.4).when(credit < 700, 0.2).otherwise(0.0)
             + F.when(is_pep, 0.5).otherwise(0.0))
    return F.least(total, F.lit(1.0))


def with_card_rules(transactions: DataFrame) -> DataFrame:
    mcc, channel = F.col("merchant_category"), F.col("channel")
    return transactions.withColumns({
        "merchant_category_encoded": F.coalesce(lookup(mcc, MERCHANT_CODES, 0), F.lit(0)),
        "is_online_transaction": F.coalesce(channel == "web_browser", F.lit(False)).cast("int"),
        "merchant_risk_score": F.coalesce(mcc.isin(*HIGH_RISK_MERCHANTS), F.lit(False)).cast("int"),
        "card_present": F.coalesce(channel.isin("pos", "atm"), F.lit(False)).cast("int")})


def with_loan_rules(transactions: DataFrame) -> DataFrame:
    """Loan inputs; a column of that name in the table replaces the placeholder."""
    return transactions.withColumns({
        "loan_amount": F.col("amount").cast("double"),
        **{n: F.lit(v) for n, v in LOAN_DEFAULTS.items() if n not in transactions.columns}})


def amount_flags(transactions: DataFrame, share: float = 0.9) -> DataFrame:
    """log1p of the amount and whether it exceeds the exact global percentile."""
    limit = exact_percentiles(transactions, [], "amount", {"limit": share})
    return transactions.select(
        "transaction_id", F.log1p(F.col("amount").cast("double")).alias("amount_log"),
        (F.col("amount").cast("double") > limit.scalar()).cast("int").alias("is_high_amount"))


def customer_history(transactions: DataFrame) -> DataFrame:
    """Per customer: mean, count, distinct beneficiaries, weekend and night shares."""
    ts = F.col("timestamp")
    stats = transactions.groupBy("customer_id").agg(
        F.avg(F.col("amount").cast("double")).alias("avg_transaction_amount"),
        F.count(F.lit(1)).alias("transaction_frequency"),
        (F.count_if(F.weekday(ts) >= 5) / F.count(F.lit(1))).alias("weekend_transaction_ratio"),
        (F.count_if(is_night(ts, "wide")) / F.count(F.lit(1))).alias("night_transaction_ratio"))
    partners = (transactions.where(F.col("beneficiary_id").isNotNull())
                .select("customer_id", "beneficiary_id").distinct()
                .groupBy("customer_id").agg(F.count(F.lit(1)).alias("unique_beneficiaries")))
    return stats.join(partners, "customer_id", "left").fillna(0, ["unique_beneficiaries"])


def modeling_table(transactions: DataFrame, profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """One complete row per labelled transaction: flags, risks, profile and history."""
    ts = F.col("timestamp")
    age_days = F.greatest(F.col("account_age_days"), F.lit(1))
    history = customer_history(transactions)
    base = transactions.select(
        "transaction_id", "customer_id",
        F.col("amount").cast("double").alias("transaction_amount"),
        F.hour(ts).alias("hour_of_day"), F.weekday(ts).alias("day_of_week"),
        (F.weekday(ts) >= 5).cast("int").alias("is_weekend"),
        is_night(ts, "wide").cast("int").alias("is_night_transaction"),
        product_risk(F.col("product_type")).alias("product_type_risk"),
        device_risk(F.col("device_id")).alias("device_risk_score"))
    risk = base_risk(F.col("age"), F.col("income"), F.col("credit_score"), F.col("is_pep") == 1)
    joined = (base.join(profiles, "customer_id", "left").join(history, "customer_id", "left")
              .join(labels.select("transaction_id", "is_fraud"), "transaction_id", "left"))
    return joined.withColumns({
        "customer_risk_score": risk,
        "velocity_score": F.col("transaction_frequency") / age_days * 30,
        "network_centrality": F.least(F.col("unique_beneficiaries") / 100, F.lit(1.0)),
    }).dropna()


def group_rates(df: DataFrame, by: str, flag: str = "is_fraud") -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum(flag).cast("bigint").alias("frauds"),
        F.round(F.avg(flag) * 100, 2).alias("fraud_percent"))


def dataset_summary(transactions: DataFrame) -> DataFrame:
    """One row: range, weekend share and the busiest hour (smallest on ties)."""
    ts = F.col("timestamp")
    hours = (transactions.groupBy(F.hour(ts).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.weekday(ts) >= 5).alias("weekend"),
        F.min(ts).alias("first"), F.max(ts).alias("last")))
    return hours.agg(
        F.sum("n").alias("transactions"), F.min("first").alias("first_transaction"),
        F.max("last").alias("last_transaction"),
        (F.sum("weekend") / F.sum("n")).alias("weekend_ratio"),
        F.max_by("h", F.struct(F.col("n"), -F.col("h"))).alias("peak_hour"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column, in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"))
                      for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.column_name", "p.v").where("v IS NOT NULL")
    stats = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    return stats.join(exact_percentiles(long, ["column_name"], "v",
                                        {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "column_name")


def stable_sample(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest seeded hash: the same rows whatever the partitioning."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    return df.withColumn("__key", key).orderBy("__key", id_column).limit(n).drop("__key")


def derived_inputs(df: DataFrame) -> DataFrame:
    """Nulls to zero, then ratios whose inputs are all present."""
    out, have = df.fillna(0), set(df.columns)

    def add(name: str, needs: tuple[str, ...], expr: Column) -> None:
        nonlocal out
        if have.issuperset(needs):
            out = out.withColumn(name, expr)

    c = F.col
    add("avg_transaction_size_24h", ("transaction_count_24h", "transaction_volume_24h"),
        c("transaction_volume_24h") / (c("transaction_count_24h") + 1))
    add("fraud_beneficiary_ratio", ("fraudulent_beneficiaries_count", "unique_beneficiaries"),
        c("fraudulent_beneficiaries_count") / (c("unique_beneficiaries") + 1))
    add("network_total_degree", ("network_out_degree", "network_in_degree"),
        c("network_out_degree") + c("network_in_degree"))
    add("velocity_ratio_1h_24h", ("transaction_count_1h", "transaction_count_24h"),
        c("transaction_count_1h") / (c("transaction_count_24h") / 24 + 0.1))
    return out
