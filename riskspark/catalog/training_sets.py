"""Training sets and deviations as they were just before each label or transaction."""

from __future__ import annotations

from riskspark.catalog.base import query, rounded
from riskspark.catalog.features import FLAGS, SAME_DAY, inputs
from riskspark.catalog.models import CONFIDENT
from riskspark.functions.times import WINDOW_HOURS
from riskspark.operators import context, models, point_in_time, training
from riskspark.sources.driver import AS_OF


def _since(h: int, row: str = "t") -> str:
    return f"{row}.timestamp >= label_timestamp - INTERVAL {h} HOUR"


def _r(expr: str) -> str:
    return f"round({expr}, 4)"


def _sent() -> str:
    cols = []
    for w, h in WINDOW_HOURS.items():
        every = _since(h)
        ok = f"FILTER (WHERE status = 'approved' AND {every})"
        cols += [f"count(amount) {ok} AS transaction_count_{w}", f"{_r(f'coalesce(sum(amount) {ok}, 0)')} AS transaction_volume_{w}",
                 f"{_r(f'coalesce(avg(amount) {ok}, 0)')} AS avg_transaction_amount_{w}",
                 f"{_r(f'coalesce(stddev_samp(amount) {ok}, 0)')} AS std_transaction_amount_{w}",
                 f"count(DISTINCT product_type) {ok} AS products_used_{w}", f"count(DISTINCT CAST(timestamp AS DATE)) {ok} AS active_days_{w}"]
        cols += [f"count(DISTINCT {c}) FILTER (WHERE {every}) AS {n}_used_{w}" for n, c in (("channels", "channel"), ("devices", "device_id"), ("ips", "ip_address"))]
        cols += [f"count(*) FILTER (WHERE channel = '{c}' AND {every}) AS {n}_transactions_{w}"
                 for n, c in (("mobile", "mobile_app"), ("web", "web_browser"), ("atm", "atm"))]
    for w in ("1h", "6h", "24h"):
        h = WINDOW_HOURS[w]
        ok = f"FILTER (WHERE status = 'approved' AND {_since(h)})"
        cols += [f"{_r(f'(count(amount) {ok}) / {h}.0::DOUBLE')} AS transaction_velocity_{w}",
                 f"{_r(f'coalesce(sum(amount) {ok}, 0) / {h}.0::DOUBLE')} AS volume_velocity_{w}"]
    moved = f"FILTER (WHERE (transaction_type = 'transfer' OR product_type = 'pix') AND t.beneficiary_id IS NOT NULL AND {_since(2160)})"
    cols += [f"count(DISTINCT device_id) FILTER (WHERE {_since(2160)}) AS unique_devices_used",
             "count(DISTINCT t.beneficiary_id) AS unique_beneficiaries",
             "count(DISTINCT fr.customer_id) AS fraudulent_beneficiaries_count",
             f"count(DISTINCT t.beneficiary_id) {moved} AS network_out_degree", f"CAST(count(*) {moved} AS DOUBLE) AS network_out_strength"]
    return ", ".join(cols)


def _visits() -> str:
    cols = []
    for w, h in WINDOW_HOURS.items():
        f = f"FILTER (WHERE {_since(h)})"
        cols += [f"count(t.timestamp) {f} AS login_count_{w}", f"{_r(f'coalesce(avg(session_duration_minutes) {f}, 0)')} AS avg_session_duration_{w}",
                 f"count(DISTINCT hour(t.timestamp)) {f} AS active_hours_{w}", f"count(DISTINCT CAST(t.timestamp AS DATE)) {f} AS login_days_{w}"]
        cols += [f"count(*) FILTER (WHERE event_type = '{e}' AND {_since(h)}) AS {n}_{w}"
                 for n, e in (("password_changes", "password_change"), ("profile_updates", "profile_update"))]
    return ", ".join(cols)


HUB_SET = f"""
WITH l AS (SELECT DISTINCT customer_id, is_fraud, label_timestamp FROM ({CONFIDENT})),
p AS (SELECT l.*, year(label_timestamp) - year(birth_date) - CASE WHEN month(label_timestamp) * 100 + day(label_timestamp)
    < month(birth_date) * 100 + day(birth_date) THEN 1 ELSE 0 END AS age,
  CAST(floor((epoch_us(label_timestamp) - epoch_us(created_at)) / 86400000000) AS BIGINT) AS days, credit_score_internal AS score, is_pep AS pep,
  CASE income_bracket WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS income,
  ((full_name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (address IS NOT NULL)::INT
    + coalesce(income_verified, false)::INT) * CAST(0.2 AS DOUBLE) AS kyc
  FROM l LEFT JOIN cust c USING (customer_id) LEFT JOIN risk r USING (customer_id)),
n AS (SELECT l.customer_id, is_fraud, label_timestamp, count(prod.customer_id) AS total_products_count FROM l
  LEFT JOIN prod ON prod.customer_id = l.customer_id AND status = 'active' AND opened_date < label_timestamp GROUP BY 1, 2, 3),
a AS (SELECT l.customer_id, is_fraud, label_timestamp, {_sent()} FROM l LEFT JOIN tx t ON t.customer_id = l.customer_id
  AND t.timestamp < label_timestamp AND {_since(4320)} LEFT JOIN fr ON fr.customer_id = t.beneficiary_id GROUP BY 1, 2, 3),
v AS (SELECT l.customer_id, is_fraud, label_timestamp, {_visits()} FROM l LEFT JOIN ce t ON t.customer_id = l.customer_id
  AND t.timestamp < label_timestamp AND {_since(2160)} GROUP BY 1, 2, 3),
i AS (SELECT l.customer_id, is_fraud, label_timestamp, count(DISTINCT t.customer_id) AS network_in_degree,
  CAST(count(t.transaction_id) AS DOUBLE) AS network_in_strength FROM l LEFT JOIN tx t ON t.beneficiary_id = l.customer_id
  AND (transaction_type = 'transfer' OR product_type = 'pix') AND t.timestamp < label_timestamp AND {_since(2160)} GROUP BY 1, 2, 3)
SELECT a.*, v.* EXCLUDE (customer_id, is_fraud, label_timestamp), network_in_degree, network_in_strength, total_products_count,
  CAST(coalesce(age, 0) AS BIGINT) AS customer_age, coalesce(days, 0) AS account_age_days, coalesce(score, 0) AS credit_score_internal,
  coalesce(pep, false)::INT AS is_pep, coalesce(income, 0) AS income_bracket_encoded, round(coalesce(kyc, 0), 4) AS kyc_completion_score
FROM a JOIN v USING (customer_id, is_fraud, label_timestamp) JOIN i USING (customer_id, is_fraud, label_timestamp)
JOIN n USING (customer_id, is_fraud, label_timestamp) JOIN p USING (customer_id, is_fraud, label_timestamp)"""


@query("hub_training_set", HUB_SET, "tx ce fl fr cust prod risk")
def hub_training_set(t):
    """Every confident label with profile, activity and own network edges just before it."""
    return rounded(training.hub_training_set(t.fraud_labels(), inputs(t), AS_OF))


DEVIATION_BEFORE = """
SELECT t.transaction_id, round((t.amount - coalesce(avg(h.amount), 0)) / greatest(coalesce(stddev_samp(h.amount), 1), 1), 4) AS amount_zscore,
  round(t.amount / greatest(coalesce(quantile_cont(h.amount, 0.95), 0), 1), 4) AS amount_vs_p95_ratio,
  round(t.amount / greatest(coalesce(max(h.amount), 0), 1), 4) AS amount_vs_max_ratio,
  (t.amount > coalesce(quantile_cont(h.amount, 0.95), 0))::INT AS is_amount_above_p95
FROM tx t LEFT JOIN tx h ON h.customer_id = t.customer_id AND h.status = 'approved' AND h.timestamp < t.timestamp
  AND h.timestamp >= t.timestamp - INTERVAL 2160 HOUR GROUP BY t.transaction_id, t.amount"""


@query("amount_deviation_point_in_time", DEVIATION_BEFORE, "tx")
def amount_deviation_point_in_time(t):
    """How far an amount is from what its customer had spent before it."""
    tx = t.transactions()
    rows = point_in_time.deviation_before(tx, tx)
    return rounded(rows.select("transaction_id", *context.DEVIATION_COLUMNS))


DISTANCE_BEFORE = """
SELECT t.transaction_id, round(CASE WHEN t.location_lat IS NULL THEN 0 ELSE coalesce(min(CASE
    WHEN h.location_lat = t.location_lat AND h.location_lon = t.location_lon THEN 0 ELSE 6371.0::DOUBLE * acos(greatest(-1.0::DOUBLE,
      least(1.0::DOUBLE, cos(radians(t.location_lat)) * cos(radians(h.location_lat)) * cos(radians(h.location_lon) - radians(t.location_lon))
      + sin(radians(t.location_lat)) * sin(radians(h.location_lat))))) END) FILTER (WHERE h.location_lat IS NOT NULL), 1000) END, 4)::DOUBLE AS distance_from_usual_location_km
FROM tx t LEFT JOIN tx h ON h.customer_id = t.customer_id AND h.location_lat IS NOT NULL AND h.timestamp < t.timestamp
  AND h.timestamp >= t.timestamp - INTERVAL 2160 HOUR GROUP BY t.transaction_id, t.location_lat"""


@query("distance_point_in_time", DISTANCE_BEFORE, "tx")
def distance_point_in_time(t):
    """Kilometres to the nearest place of the customer in the 90 days before each transaction."""
    tx = t.transactions()
    return rounded(point_in_time.location_before(tx, tx).select("transaction_id", "distance_from_usual_location_km"))


PRODUCT_SET = f"""
WITH f AS ({FLAGS}), s AS ({SAME_DAY}), d AS ({DISTANCE_BEFORE}), v AS ({DEVIATION_BEFORE}),
b AS (SELECT customer_id, beneficiary_id, min(timestamp) AS first FROM tx WHERE product_type = 'pix' AND beneficiary_id IS NOT NULL GROUP BY 1, 2)
SELECT t.transaction_id, t.customer_id, t.timestamp, l.is_fraud, transaction_amount, is_round_amount, is_weekend, hour_of_day, is_night_transaction,
  minutes_since_last_transaction, distance_from_usual_location_km, amount_zscore, CASE WHEN first < t.timestamp THEN 0 ELSE 1 END AS is_new_beneficiary
FROM tx t JOIN ({CONFIDENT}) l USING (transaction_id) JOIN f USING (transaction_id) JOIN s USING (transaction_id) JOIN d USING (transaction_id)
JOIN v USING (transaction_id) LEFT JOIN b ON b.customer_id = t.customer_id AND b.beneficiary_id = t.beneficiary_id WHERE t.product_type = 'pix'"""


@query("product_training_set", PRODUCT_SET, "tx fl")
def product_training_set(t):
    """Labelled instant payments with their context as of their own time, before the hub score is added."""
    spoke = models.SPOKES["pix"]
    rows = models.labelled_context(t.transactions(), t.fraud_labels(), AS_OF, spoke.product)
    return rounded(models.product_training_set(spoke, rows))
