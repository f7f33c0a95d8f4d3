"""Decision rules, model quality and modelling-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalog.base import fixed, query, rounded
from riskspark.catalog.features import DEVIATION, FLAGS
from riskspark.operators import context, decide, metrics, modeling_table
from riskspark.sources.driver import AS_OF

THRESHOLDS = {"pix": decide.Thresholds(0.15, 0.45, 0.75)}

FINAL = """
SELECT transaction_id, hub_score AS h, spoke_score AS s,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE
    WHEN hub_score > 0.7::DOUBLE AND spoke_score > 0.7::DOUBLE THEN least(1.0::DOUBLE, (hub_score * 0.4::DOUBLE + spoke_score * 0.6::DOUBLE) * 1.2::DOUBLE)
    WHEN hub_score < 0.2::DOUBLE AND spoke_score > 0.8::DOUBLE THEN (hub_score * 0.4::DOUBLE + spoke_score * 0.6::DOUBLE) * 0.8::DOUBLE
    ELSE hub_score * 0.4::DOUBLE + spoke_score * 0.6::DOUBLE END)) AS f FROM sc"""

LEVELED = f"""
SELECT x.*, t.product_type, t.customer_id, CASE
  WHEN f >= CASE product_type WHEN 'pix' THEN 0.75::DOUBLE ELSE 0.8::DOUBLE END THEN 'high'
  WHEN f >= CASE product_type WHEN 'pix' THEN 0.45::DOUBLE ELSE 0.5::DOUBLE END THEN 'medium' ELSE 'low' END AS lvl
FROM ({FINAL}) x JOIN tx t USING (transaction_id)"""

ACTION = "CASE lvl WHEN 'low' THEN 'approve' WHEN 'medium' THEN 'challenge' ELSE 'reject' END"


def scored(t):
    """Transactions with given hub and spoke scores and the features the rules read."""
    tx = t.transactions()
    return (tx.select("transaction_id", "customer_id", "product_type")
            .join(t.scored(), "transaction_id")
            .join(context.transaction_flags(tx).select("transaction_id", "is_night_transaction"), "transaction_id")
            .join(context.amount_deviation(tx, tx, AS_OF).select("transaction_id", "amount_zscore"), "transaction_id"))


def decisions(t):
    return decide.decide(scored(t), THRESHOLDS, ["is_night_transaction", "amount_zscore"])


@query("decisions", f"""
WITH l AS ({LEVELED}), fl0 AS ({FLAGS}), dv AS ({DEVIATION}),
r AS (SELECT l.*, list_filter([CASE WHEN lvl = 'high' THEN 'HIGH_RISK_TRANSACTION' END,
    CASE WHEN h > 0.7::DOUBLE THEN 'HIGH_CUSTOMER_RISK_PROFILE' END,
    CASE WHEN s > 0.7::DOUBLE THEN 'SUSPICIOUS_TRANSACTION_PATTERN' END,
    CASE WHEN is_night_transaction = 1 THEN 'UNUSUAL_TIME_OF_DAY' END,
    CASE WHEN amount_zscore > 2 THEN 'UNUSUAL_AMOUNT' END], lambda x: x IS NOT NULL)[1:5] AS codes
  FROM l JOIN fl0 USING (transaction_id) JOIN dv USING (transaction_id))
SELECT transaction_id, product_type, round(h, 4) AS hub_risk_score, round(s, 4) AS spoke_fraud_score,
  round(f, 4) AS final_score, lvl AS risk_level, {ACTION} AS action, array_to_string(codes, ',') AS reasons,
  CASE WHEN f > 0.5::DOUBLE THEN 'fraud' ELSE 'legitimate' END AS predicted_class, round(greatest(f, 1 - f), 4) AS confidence
FROM r""", "tx sc")
def decisions_query(t):
    """Combined score, level, action, first five reasons, class and confidence."""
    d = decisions(t)
    return rounded(d.select("transaction_id", "product_type", "hub_risk_score", "spoke_fraud_score", "final_score",
                            "risk_level", "action", F.concat_ws(",", "reason_codes").alias("reasons"),
                            "predicted_class", "confidence"))


@query("decision_explanations", f"""
SELECT transaction_id, 'Customer risk level: ' || {fixed("h", 2)} || ', Transaction risk: ' || {fixed("s", 2)} AS summary,
  {fixed("h * 0.4::DOUBLE", 3)} || ' (40% weight)' AS hub_model_contribution, {fixed("s * 0.6::DOUBLE", 3)} || ' (60% weight)' AS spoke_model_contribution,
  'Final score: ' || {fixed("f", 3)} AS final_score_calculation, 'is_night_transaction,amount_zscore' AS factors FROM ({FINAL})""", "sc")
def decision_explanations(t):
    return decisions(t).select("transaction_id", "explanation.summary", "explanation.hub_model_contribution", "explanation.spoke_model_contribution",
                               "explanation.final_score_calculation", F.concat_ws(",", "explanation.key_risk_factors").alias("factors"))


@query("decision_reasons", f"""
WITH l AS ({LEVELED}), fl0 AS ({FLAGS}), dv AS ({DEVIATION}),
r AS (SELECT *, transaction_id * 37 % 250 AS km, transaction_id % 3 AS fresh, transaction_id % 5 AS risky, transaction_id % 8 AS sharing
  FROM l JOIN fl0 USING (transaction_id) JOIN dv USING (transaction_id))
SELECT transaction_id, array_to_string(list_filter([CASE WHEN lvl = 'high' THEN 'HIGH_RISK_TRANSACTION' END,
    CASE WHEN h > 0.7::DOUBLE THEN 'HIGH_CUSTOMER_RISK_PROFILE' END, CASE WHEN s > 0.7::DOUBLE THEN 'SUSPICIOUS_TRANSACTION_PATTERN' END,
    CASE WHEN is_night_transaction = 1 THEN 'UNUSUAL_TIME_OF_DAY' END, CASE WHEN km > 100 THEN 'UNUSUAL_LOCATION' END,
    CASE WHEN amount_zscore > 2 THEN 'UNUSUAL_AMOUNT' END, CASE WHEN fresh = 1 THEN 'NEW_BENEFICIARY' END,
    CASE WHEN risky > 0 THEN 'RISKY_BENEFICIARY_NETWORK' END, CASE WHEN sharing > 5 THEN 'SHARED_DEVICE_RISK' END],
  lambda x: x IS NOT NULL)[1:5], ',') AS reasons FROM r""", "tx sc")
def decision_reasons(t):
    """All nine rules; distance, new beneficiary and network inputs by formula, so that every rule fires in some row."""
    i = F.col("transaction_id")
    rows = scored(t).withColumns({"distance_from_usual_location_km": i * 37 % 250, "is_new_beneficiary": i % 3,
                                  "fraudulent_beneficiaries_count": i % 5, "customers_sharing_devices": i % 8})
    return decide.decide(rows, THRESHOLDS, with_explanation=False).select(
        "transaction_id", F.concat_ws(",", "reason_codes").alias("reasons"))


@query("safe_default_decisions", f"""
SELECT transaction_id, CASE WHEN bad THEN 0.5 ELSE round(f, 4) END::DOUBLE AS final_score,
  CASE WHEN bad THEN 'medium' ELSE lvl END AS risk_level,
  CASE WHEN bad THEN 'manual_review' ELSE {ACTION} END AS action,
  CASE WHEN bad THEN 'SYSTEM_ERROR,MANUAL_REVIEW_REQUIRED' END AS errors
FROM (SELECT *, transaction_id % 31 = 0 AS bad FROM ({LEVELED}))""", "tx sc")
def safe_default_decisions(t):
    """Rows whose score is missing fall back to the safe default."""
    base = t.transactions().select("transaction_id", "customer_id", "product_type").join(t.scored(), "transaction_id")
    broken = base.withColumn("spoke_score", F.when(F.col("transaction_id") % 31 != 0, F.col("spoke_score")))
    d = decide.decide(broken, THRESHOLDS, with_explanation=False)
    errors = F.when(F.array_contains("reason_codes", "SYSTEM_ERROR"), F.concat_ws(",", "reason_codes"))
    return rounded(d.select("transaction_id", "final_score", "risk_level", "action", errors.alias("errors")))


@query("high_risk_alerts", f"SELECT transaction_id, customer_id, round(f, 4) AS final_score FROM ({LEVELED}) WHERE lvl = 'high'", "tx sc")
def high_risk_alerts(t):
    return rounded(decide.high_risk_alerts(decisions(t)).select("transaction_id", "customer_id", "final_score"))


@query("decision_distribution", f"""
SELECT lvl AS risk_level, {ACTION} AS action, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM ({LEVELED}) GROUP BY 1, 2""", "tx sc")
def decision_distribution(t):
    return rounded(decide.decision_distribution(decisions(t)))


@query("prediction_log", f"""
SELECT transaction_id, customer_id, product_type, round(h, 4) AS hub_score, round(s, 4) AS spoke_score,
  round(f, 4) AS final_score, lvl AS risk_level, {ACTION} AS action, CAST(NULL AS DOUBLE) AS processing_time_ms,
  TIMESTAMP '{AS_OF}' AS timestamp, '{{"hub_model":"1","spoke_model":"1"}}' AS model_versions FROM ({LEVELED})""", "tx sc")
def prediction_log(t):
    return rounded(decide.prediction_log(decisions(t), {"hub_model": "1", "spoke_model": "1"}, AS_OF))


def labelled_scores(t):
    return t.scored().join(t.fraud_labels(), "transaction_id").select(
        "transaction_id", F.col("spoke_score").alias("score"), F.col("is_fraud").alias("label"),
        (F.col("spoke_score") > 0.5).cast("int").alias("prediction"))


LS = """SELECT transaction_id, spoke_score AS score, is_fraud AS label, (spoke_score > 0.5::DOUBLE)::INT AS prediction
FROM sc JOIN fl USING (transaction_id)"""


@query("threshold_metrics", f"""
WITH l AS ({LS}), m AS (SELECT th, count(*) FILTER (WHERE score >= th AND label = 1) AS tp,
  count(*) FILTER (WHERE score >= th) AS fl0, count(*) FILTER (WHERE label = 1) AS p
  FROM l, (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9]::DOUBLE[]) AS th) GROUP BY th),
r AS (SELECT th, CASE WHEN fl0 > 0 THEN tp / fl0 ELSE 0 END AS pr, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS re FROM m)
SELECT th AS threshold, round(pr, 4) AS precision, round(re, 4) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM r""", "sc fl")
def threshold_metrics(t):
    return rounded(metrics.threshold_metrics(labelled_scores(t)))


@query("roc_pr_points", f"""
WITH l AS ({LS}), c AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM l GROUP BY 1),
k AS (SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 4) AS threshold, tp, fp, round(tp / ap, 4) AS tpr, round(fp / an, 4) AS fpr,
  round(tp / (tp + fp), 4) AS precision FROM k""", "sc fl")
def roc_pr_points(t):
    return rounded(metrics.curve_points(labelled_scores(t)).select("threshold", "tp", "fp", "tpr", "fpr", "precision"))


@query("auc", f"""
WITH l AS ({LS}), c AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM l GROUP BY 1),
k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) - pos + pos / 2 AS beat FROM c)
SELECT round(sum(neg * beat) / (sum(pos) * sum(neg)), 4) AS auc, CAST(sum(pos) AS BIGINT) AS positives,
  CAST(sum(neg) AS BIGINT) AS negatives FROM k""", "sc fl")
def auc(t):
    return rounded(metrics.auc(labelled_scores(t)))


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM ({LS}) GROUP BY 1, 2", "sc fl")
def confusion_matrix(t):
    return metrics.confusion(labelled_scores(t))


@query("class_report", f"""
WITH l AS ({LS}), c AS (SELECT unnest([0, 1]) AS class),
m AS (SELECT class, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE prediction = class) AS fl0,
  count(*) FILTER (WHERE label = class AND prediction = class) AS hit FROM c, l GROUP BY 1),
r AS (SELECT class, support, hit / fl0 AS p, hit / support AS r FROM m)
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1, support FROM r""", "sc fl")
def class_report(t):
    return rounded(metrics.class_report(labelled_scores(t)))


PROD_RISK = ("CASE upper(product_type) WHEN 'PIX' THEN 0.7 WHEN 'TED' THEN 0.5 WHEN 'DOC' THEN 0.3 "
             "WHEN 'DEBIT' THEN 0.2 ELSE 0.5 END::DOUBLE")
DEV_RISK = "CASE WHEN CAST(split_part(device_id, '_', 2) AS BIGINT) > 9000 THEN 0.8 ELSE 0.2 END::DOUBLE"
BASE_RISK = ("least(1.0::DOUBLE, CASE WHEN age < 25 OR age > 70 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN income < 30000 THEN 0.3 ELSE 0 END::DOUBLE "
             "+ CASE WHEN credit_score < 600 THEN 0.4 WHEN credit_score < 700 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN is_pep = 1 THEN 0.5 ELSE 0 END::DOUBLE)")


@query("rule_risks", f"SELECT transaction_id, {PROD_RISK} AS product_risk, {DEV_RISK} AS device_risk FROM tx", "tx")
def rule_risks(t):
    return t.transactions().select(
        "transaction_id", modeling_table.product_risk(F.col("product_type")).alias("product_risk"),
        modeling_table.device_risk(F.col("device_id")).alias("device_risk"))


@query("customer_segments", f"""
SELECT customer_id, CASE WHEN income >= 100000 AND credit_score >= 750 THEN 'premium'
  WHEN income >= 50000 AND credit_score >= 650 THEN 'standard' ELSE 'basic' END AS segment,
  round({BASE_RISK}, 4) AS base_risk FROM demo""", "demo")
def customer_segments(t):
    c = F.col
    return rounded(t.demo_profiles().select(
        "customer_id", modeling_table.segment(c("income"), c("credit_score")).alias("segment"),
        modeling_table.base_risk(c("age"), c("income"), c("credit_score"), c("is_pep") == 1).alias("base_risk")))


@query("amount_flags", """
SELECT transaction_id, round(ln(1 + amount), 4) AS amount_log,
  (amount > (SELECT quantile_cont(amount, 0.9) FROM tx))::INT AS is_high_amount FROM tx""", "tx")
def amount_flags(t):
    return rounded(modeling_table.amount_flags(t.transactions()))


@query("card_rules", """
SELECT transaction_id, CASE merchant_category WHEN '5411' THEN 1 WHEN '5541' THEN 2 WHEN '5812' THEN 3
    WHEN '5999' THEN 4 ELSE 0 END AS merchant_category_encoded,
  (channel = 'web_browser')::INT AS is_online_transaction,
  coalesce(merchant_category IN ('5812','5813','7995','5933'), false)::INT AS merchant_risk_score,
  (channel IN ('pos','atm'))::INT AS card_present FROM tx WHERE product_type = 'credit_card'""", "tx")
def card_rules(t):
    rows = modeling_table.with_card_rules(t.transactions().where("product_type = 'credit_card'"))
    return rows.select("transaction_id", "merchant_category_encoded", "is_online_transaction", "merchant_risk_score", "card_present")


@query("loan_rules", """
SELECT transaction_id, round(amount, 4) AS loan_amount, 1 AS loan_purpose_encoded, 0.3::DOUBLE AS debt_to_income_ratio,
  0.8::DOUBLE AS employment_stability_score, 1.2::DOUBLE AS collateral_value_ratio, 0.15::DOUBLE AS interest_rate
FROM tx WHERE product_type = 'loan'""", "tx")
def loan_rules(t):
    rows = modeling_table.with_loan_rules(t.transactions().where("product_type = 'loan'"))
    return rounded(rows.select("transaction_id", "loan_amount", *modeling_table.LOAN_DEFAULTS))


HISTORY = """
SELECT customer_id, avg(amount) AS avg_transaction_amount, count(*) AS transaction_frequency,
  count(*) FILTER (WHERE isodow(timestamp) >= 6) / count(*) AS weekend_transaction_ratio,
  count(*) FILTER (WHERE hour(timestamp) >= 22 OR hour(timestamp) <= 6) / count(*) AS night_transaction_ratio,
  count(DISTINCT beneficiary_id) AS unique_beneficiaries FROM tx GROUP BY 1"""


@query("customer_history", f"""SELECT customer_id, round(avg_transaction_amount, 4) AS avg_transaction_amount, transaction_frequency,
  round(weekend_transaction_ratio, 4) AS weekend_transaction_ratio, round(night_transaction_ratio, 4) AS night_transaction_ratio,
  unique_beneficiaries FROM ({HISTORY})""", "tx")
def customer_history(t):
    return rounded(modeling_table.customer_history(t.transactions()))


@query("modeling_table", f"""
SELECT transaction_id, customer_id, round(amount, 4) AS transaction_amount, CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
  CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, (isodow(timestamp) >= 6)::INT AS is_weekend,
  (hour(timestamp) >= 22 OR hour(timestamp) <= 6)::INT AS is_night_transaction,
  {PROD_RISK} AS product_type_risk, {DEV_RISK} AS device_risk_score, age, round(income, 4) AS income, credit_score,
  account_age_days, is_pep, high_risk_location, round(avg_transaction_amount, 4) AS avg_transaction_amount, transaction_frequency,
  round(weekend_transaction_ratio, 4) AS weekend_transaction_ratio, round(night_transaction_ratio, 4) AS night_transaction_ratio,
  unique_beneficiaries, is_fraud, round({BASE_RISK}, 4) AS customer_risk_score,
  round(transaction_frequency / greatest(account_age_days, 1) * 30, 4) AS velocity_score,
  round(least(unique_beneficiaries / 100, 1), 4)::DOUBLE AS network_centrality
FROM tx JOIN demo USING (customer_id) JOIN ({HISTORY}) USING (customer_id)
JOIN (SELECT transaction_id, is_fraud FROM fl) USING (transaction_id)""", "tx demo fl")
def modeling(t):
    return rounded(modeling_table.modeling_table(t.transactions(), t.demo_profiles(), t.fraud_labels()))


@query("fraud_rate_by_product", """
SELECT product_type, count(*) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS frauds,
  round(avg(is_fraud) * 100, 2) AS fraud_percent FROM tx JOIN fl USING (transaction_id) GROUP BY 1""", "tx fl")
def fraud_rate_by_product(t):
    labels = t.fraud_labels().select("transaction_id", "is_fraud")
    return modeling_table.group_rates(t.transactions().join(labels, "transaction_id"), "product_type")


@query("fraud_rate_by_channel", """
SELECT channel, count(*) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS frauds,
  round(avg(is_fraud) * 100, 2) AS fraud_percent FROM tx JOIN fl USING (transaction_id) GROUP BY 1""", "tx fl")
def fraud_rate_by_channel(t):
    labels = t.fraud_labels().select("transaction_id", "is_fraud")
    return modeling_table.group_rates(t.transactions().join(labels, "transaction_id"), "channel")


@query("dataset_summary", """
SELECT count(*) AS transactions, min(timestamp) AS first_transaction, max(timestamp) AS last_transaction,
  round(count(*) FILTER (WHERE isodow(timestamp) >= 6) / count(*), 4) AS weekend_ratio,
  CAST((SELECT hour(timestamp) FROM tx GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS INTEGER) AS peak_hour FROM tx""", "tx")
def dataset_summary(t):
    return rounded(modeling_table.dataset_summary(t.transactions()))


def _profile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75 FROM {table}" for c in columns)


@query("numeric_profile", _profile_sql("demo", ["age", "income", "credit_score", "account_age_days"]), "demo")
def numeric_profile(t):
    return rounded(modeling_table.numeric_profile(t.demo_profiles(), ["age", "income", "credit_score", "account_age_days"]))


@query("stable_sample", "SELECT transaction_id, amount FROM tx ORDER BY md5('42:' || transaction_id), transaction_id LIMIT 500", "tx")
def stable_sample(t):
    """Sampling is the operator here: n rows by seeded hash."""
    return modeling_table.stable_sample(t.transactions().select("transaction_id", "amount"), "transaction_id", 500)
