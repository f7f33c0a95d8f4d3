"""Feature pillars, registered one operator at a time and as whole vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalog.base import ASOF_SQL, query, rounded
from riskspark.functions.times import WINDOW_HOURS
from riskspark.operators import behavior, context, network, profile, registry
from riskspark.sources import tables
from riskspark.sources.driver import AS_OF

W = WINDOW_HOURS


def _cond(h: int, ts: str = "timestamp") -> str:
    return f"{ts} >= {ASOF_SQL} - INTERVAL {h} HOUR"


def _within(h: int, ts: str = "timestamp") -> str:
    return f"{_cond(h, ts)} AND {ts} <= {ASOF_SQL}"


def _per_window(make) -> str:
    return ", ".join(c for w, h in W.items() for c in make(w, _cond(h)))


def _r(expr: str) -> str:
    return f"round({expr}, 4)"


TXN_WINDOWS = "SELECT customer_id, " + _per_window(lambda w, c: [
    f"count(*) FILTER (WHERE {c}) AS transaction_count_{w}",
    f"{_r(f'coalesce(sum(amount) FILTER (WHERE {c}), 0)')} AS transaction_volume_{w}",
    f"{_r(f'coalesce(avg(amount) FILTER (WHERE {c}), 0)')} AS avg_transaction_amount_{w}",
    f"{_r(f'coalesce(stddev_samp(amount) FILTER (WHERE {c}), 0)')} AS std_transaction_amount_{w}",
]) + f" FROM tx WHERE status = 'approved' AND {_within(2160)} GROUP BY customer_id"

DIVERSITY = "SELECT customer_id, " + _per_window(lambda w, c: [
    f"count(DISTINCT CASE WHEN status = 'approved' AND {c} THEN product_type END) AS products_used_{w}",
    f"count(DISTINCT CASE WHEN status = 'approved' AND {c} THEN CAST(timestamp AS DATE) END) AS active_days_{w}",
    f"count(DISTINCT CASE WHEN {c} THEN channel END) AS channels_used_{w}",
    f"count(DISTINCT CASE WHEN {c} THEN device_id END) AS devices_used_{w}",
    f"count(DISTINCT CASE WHEN {c} THEN ip_address END) AS ips_used_{w}",
]) + f" FROM tx WHERE {_within(2160)} GROUP BY customer_id"

CHANNELS = "SELECT customer_id, " + _per_window(lambda w, c: [
    f"count(*) FILTER (WHERE {c} AND channel = '{full}') AS {short}_transactions_{w}"
    for short, full in (("mobile", "mobile_app"), ("web", "web_browser"), ("atm", "atm"))
]) + f" FROM tx WHERE {_within(2160)} GROUP BY customer_id"

DIGITAL = "SELECT customer_id, " + _per_window(lambda w, c: [
    f"count(*) FILTER (WHERE {c}) AS login_count_{w}",
    f"{_r(f'coalesce(avg(session_duration_minutes) FILTER (WHERE {c}), 0)')} AS avg_session_duration_{w}",
    f"count(*) FILTER (WHERE {c} AND event_type = 'password_change') AS password_changes_{w}",
    f"count(*) FILTER (WHERE {c} AND event_type = 'profile_update') AS profile_updates_{w}",
    f"count(DISTINCT CASE WHEN {c} THEN hour(timestamp) END) AS active_hours_{w}",
    f"count(DISTINCT CASE WHEN {c} THEN CAST(timestamp AS DATE) END) AS login_days_{w}",
]) + f" FROM ce WHERE {_within(2160)} GROUP BY customer_id"

VELOCITY = "SELECT customer_id, " + ", ".join(
    f"{_r(f'(count(*) FILTER (WHERE {_cond(W[w])})) / {W[w]}.0::DOUBLE')} AS transaction_velocity_{w}, "
    f"{_r(f'coalesce(sum(amount) FILTER (WHERE {_cond(W[w])}), 0) / {W[w]}.0::DOUBLE')} AS volume_velocity_{w}"
    for w in ("1h", "6h", "24h")) + f" FROM tx WHERE status = 'approved' AND {_within(2160)} GROUP BY customer_id"

AGE = (f"year({ASOF_SQL}) - year(birth_date) - CASE WHEN month({ASOF_SQL}) * 100 + day({ASOF_SQL}) "
       "< month(birth_date) * 100 + day(birth_date) THEN 1 ELSE 0 END")

PROFILE = f"""
SELECT c.customer_id, {AGE} AS customer_age,
  CAST(floor((epoch_us({ASOF_SQL}) - epoch_us(created_at)) / 86400000000) AS BIGINT) AS account_age_days,
  coalesce(n, 0) AS total_products_count, coalesce(credit_score_internal, 0) AS credit_score_internal,
  coalesce(is_pep, false) AS is_pep,
  CASE income_bracket WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS income_bracket_encoded,
  round(((full_name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT
    + (address IS NOT NULL)::INT + coalesce(income_verified, false)::INT) * CAST(0.2 AS DOUBLE), 4) AS kyc_completion_score
FROM cust c LEFT JOIN (SELECT customer_id, count(*) AS n FROM prod WHERE status = 'active' GROUP BY 1) p
  ON c.customer_id = p.customer_id LEFT JOIN risk r ON c.customer_id = r.customer_id"""

DEVICES = f"""
WITH pairs AS (SELECT DISTINCT customer_id, device_id FROM tx WHERE device_id IS NOT NULL AND {_within(2160)}),
users AS (SELECT device_id, count(*) AS n FROM pairs GROUP BY 1),
mates AS (SELECT a.customer_id, count(DISTINCT b.customer_id) - 1 AS m FROM pairs a JOIN pairs b USING (device_id) GROUP BY 1)
SELECT p.customer_id, max(m) AS customers_sharing_devices, count(*) AS unique_devices_used,
  max(n) AS max_customers_per_device
FROM pairs p JOIN users USING (device_id) JOIN mates ON mates.customer_id = p.customer_id GROUP BY p.customer_id"""

BENEF = f"""
WITH pairs AS (SELECT DISTINCT customer_id, beneficiary_id FROM tx WHERE beneficiary_id IS NOT NULL AND {_within(4320)}),
b AS (SELECT beneficiary_id, count(*) AS senders FROM pairs GROUP BY 1)
SELECT p.customer_id, count(*) AS unique_beneficiaries, round(avg(senders), 4) AS avg_senders_per_beneficiary,
  max(senders) AS max_senders_per_beneficiary, count(f.customer_id) AS fraudulent_beneficiaries_count
FROM pairs p JOIN b USING (beneficiary_id) LEFT JOIN fr f ON f.customer_id = p.beneficiary_id GROUP BY p.customer_id"""

DEGREES = f"""
WITH e AS (SELECT customer_id, beneficiary_id, count(*) AS w FROM tx
  WHERE (transaction_type = 'transfer' OR product_type = 'pix') AND beneficiary_id IS NOT NULL AND {_within(2160)} GROUP BY 1, 2),
o AS (SELECT customer_id, count(*) AS d, sum(w) AS s FROM e GROUP BY 1),
i AS (SELECT beneficiary_id AS customer_id, count(*) AS d, sum(w) AS s FROM e GROUP BY 1)
SELECT coalesce(o.customer_id, i.customer_id) AS customer_id, coalesce(o.d, 0) AS network_out_degree,
  coalesce(i.d, 0) AS network_in_degree, CAST(coalesce(o.s, 0) AS DOUBLE) AS network_out_strength,
  CAST(coalesce(i.s, 0) AS DOUBLE) AS network_in_strength
FROM o FULL JOIN i ON o.customer_id = i.customer_id"""

FLAGS = """
SELECT transaction_id, customer_id, round(amount, 4) AS transaction_amount,
  (amount % 1 = 0)::INT AS is_round_amount, (isodow(timestamp) >= 6)::INT AS is_weekend,
  CAST(hour(timestamp) AS INTEGER) AS hour_of_day, (hour(timestamp) < 6 OR hour(timestamp) > 22)::INT AS is_night_transaction,
  (channel = 'mobile_app')::INT AS is_mobile_channel, (channel = 'web_browser')::INT AS is_web_channel,
  (channel = 'atm')::INT AS is_atm_channel FROM tx"""

SAME_DAY = """
SELECT transaction_id, count(*) OVER w AS transactions_today,
  coalesce(CAST(floor(round((epoch_us(timestamp) - epoch_us(max(timestamp) OVER w)) / 1000000) / 60) AS BIGINT), 1440)
    AS minutes_since_last_transaction
FROM tx WINDOW w AS (PARTITION BY customer_id, CAST(timestamp AS DATE) ORDER BY timestamp
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""


def _distance(as_of: str) -> str:
    return f"""
WITH h AS (SELECT DISTINCT customer_id, location_lat AS y, location_lon AS x FROM tx
  WHERE location_lat IS NOT NULL AND timestamp >= TIMESTAMP '{as_of}' - INTERVAL 2160 HOUR AND timestamp <= TIMESTAMP '{as_of}'),
d AS (SELECT t.transaction_id, min(CASE WHEN y = location_lat AND x = location_lon THEN 0 ELSE
    6371.0::DOUBLE * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cos(radians(location_lat)) * cos(radians(y))
      * cos(radians(x) - radians(location_lon)) + sin(radians(location_lat)) * sin(radians(y))))) END) AS km
  FROM tx t JOIN h ON h.customer_id = t.customer_id WHERE location_lat IS NOT NULL GROUP BY 1)
SELECT t.transaction_id, round(CASE WHEN location_lat IS NULL THEN 0 ELSE coalesce(km, 1000) END, 4)::DOUBLE
  AS distance_from_usual_location_km FROM tx t LEFT JOIN d USING (transaction_id)"""


MID_MONTH = "2024-01-10 00:00:00"

DEVIATION = f"""
WITH b AS (SELECT customer_id, avg(amount) AS a, stddev_samp(amount) AS s, quantile_cont(amount, 0.95) AS p, max(amount) AS m
  FROM tx WHERE status = 'approved' AND {_within(2160)} GROUP BY 1)
SELECT transaction_id, round((amount - coalesce(a, 0)) / greatest(coalesce(s, 1), 1), 4) AS amount_zscore,
  round(amount / greatest(coalesce(p, 0), 1), 4) AS amount_vs_p95_ratio,
  round(amount / greatest(coalesce(m, 0), 1), 4) AS amount_vs_max_ratio,
  (amount > coalesce(p, 0))::INT AS is_amount_above_p95
FROM tx LEFT JOIN b USING (customer_id)"""


@query("txn_window_features", TXN_WINDOWS, "tx")
def txn_window_features(t):
    """Approved count, volume, mean and deviation in six trailing windows."""
    return rounded(behavior.transaction_windows(t.transactions(), AS_OF))


@query("txn_diversity_features", DIVERSITY, "tx")
def txn_diversity_features(t):
    return behavior.transaction_diversity(t.transactions(), AS_OF)


@query("channel_features", CHANNELS, "tx")
def channel_features(t):
    return behavior.channel_counts(t.transactions(), AS_OF)


@query("digital_activity_features", DIGITAL, "ce")
def digital_activity_features(t):
    return rounded(behavior.digital_activity(t.customer_events(), AS_OF))


@query("velocity_features", VELOCITY, "tx")
def velocity_features(t):
    wide = behavior.velocity(behavior.transaction_windows(t.transactions(), AS_OF))
    return rounded(wide.select("customer_id", *[c for c in wide.columns if "_velocity_" in c]))


@query("profile_features", PROFILE, "cust prod risk")
def profile_features(t):
    return rounded(profile.profile_features(t.customers(), t.customer_products(), t.risk_profile(), AS_OF))


@query("device_sharing_features", DEVICES, "tx")
def device_sharing_features(t):
    return network.device_sharing(t.transactions(), AS_OF)


@query("beneficiary_network_features", BENEF, "tx fr")
def beneficiary_network_features(t):
    return rounded(network.beneficiary_network(t.transactions(), t.fraud_records(), AS_OF))


@query("transfer_degree_features", DEGREES, "tx")
def transfer_degree_features(t):
    return network.transfer_degrees(t.transactions(), AS_OF)


@query("transaction_flags", FLAGS, "tx")
def transaction_flags(t):
    return rounded(context.transaction_flags(t.transactions()))


@query("transaction_flags_wide_night",
       "SELECT transaction_id, (hour(timestamp) >= 22 OR hour(timestamp) <= 6)::INT AS is_night_transaction FROM tx", "tx")
def transaction_flags_wide_night(t):
    return context.transaction_flags(t.transactions(), night="wide").select("transaction_id", "is_night_transaction")


@query("same_day_history", SAME_DAY, "tx")
def same_day_history(t):
    return context.same_day_history(t.transactions())


@query("same_day_history_of_later_rows", f"""
SELECT s.* FROM ({SAME_DAY}) s JOIN tx USING (transaction_id) WHERE timestamp >= TIMESTAMP '2024-01-15 12:00:00'""", "tx")
def same_day_history_of_later_rows(t):
    """The rows from a noon on, against all stored transactions."""
    tx = t.transactions()
    return context.same_day_history(tx.where("timestamp >= TIMESTAMP_NTZ '2024-01-15 12:00:00'"), tx)


@query("distance_from_usual_location", _distance(AS_OF), "tx")
def distance_from_usual_location(t):
    return rounded(context.nearest_usual_location(t.transactions(), t.transactions(), AS_OF))


@query("distance_from_earlier_locations", _distance(MID_MONTH), "tx")
def distance_from_earlier_locations(t):
    """All transactions against the places known on an earlier date."""
    return rounded(context.nearest_usual_location(t.transactions(), t.transactions(), MID_MONTH, cell_degrees=0.1))


@query("amount_deviation", DEVIATION, "tx")
def amount_deviation(t):
    return rounded(context.amount_deviation(t.transactions(), t.transactions(), AS_OF))


@query("contextual_features", f"""
WITH f AS ({FLAGS}), s AS ({SAME_DAY}), d AS ({_distance(AS_OF)}), v AS ({DEVIATION})
SELECT * FROM f JOIN s USING (transaction_id) JOIN d USING (transaction_id) JOIN v USING (transaction_id)""", "tx")
def contextual_features(t):
    return rounded(context.contextual_features(t.transactions(), t.transactions(), AS_OF))


def inputs(t) -> registry.Inputs:
    return registry.Inputs(t.customers(), t.transactions(), t.customer_events(), t.customer_products(),
                           t.risk_profile(), t.fraud_records(), AS_OF)


def _zeros(part: str, columns: list[str], defaults: dict[str, str] | None = None) -> str:
    return ", ".join(f"coalesce({part}.{c}, {(defaults or {}).get(c, '0')}) AS {c}" for c in columns)


_TXN_COLS = [f"{p}_{w}" for w in W for p in ("transaction_count", "transaction_volume", "avg_transaction_amount", "std_transaction_amount")]
_DIV_COLS = [f"{p}_{w}" for w in W for p in ("products_used", "active_days", "channels_used", "devices_used", "ips_used")]
_CH_COLS = [f"{p}_transactions_{w}" for w in W for p in ("mobile", "web", "atm")]
_DIG_COLS = [f"{p}_{w}" for w in W for p in ("login_count", "avg_session_duration", "password_changes", "profile_updates", "active_hours", "login_days")]
_VEL_COLS = [f"{p}_{w}" for w in ("1h", "6h", "24h") for p in ("transaction_velocity", "volume_velocity")]

BEHAVIORAL = f"""
WITH a AS ({TXN_WINDOWS}), b AS ({DIVERSITY}), c AS ({CHANNELS}), d AS ({DIGITAL}), v AS ({VELOCITY}),
ids AS (SELECT customer_id FROM a UNION SELECT customer_id FROM b UNION SELECT customer_id FROM c UNION SELECT customer_id FROM d)
SELECT ids.customer_id, {_zeros('a', _TXN_COLS)}, {_zeros('b', _DIV_COLS)}, {_zeros('c', _CH_COLS)},
  {_zeros('d', _DIG_COLS)}, {_zeros('v', _VEL_COLS)}
FROM ids LEFT JOIN a USING (customer_id) LEFT JOIN b USING (customer_id) LEFT JOIN c USING (customer_id)
  LEFT JOIN d USING (customer_id) LEFT JOIN v USING (customer_id)"""

_NET = {"dv": ["customers_sharing_devices", "unique_devices_used", "max_customers_per_device"],
        "bn": ["unique_beneficiaries", "avg_senders_per_beneficiary", "max_senders_per_beneficiary",
               "fraudulent_beneficiaries_count"],
        "dg": ["network_out_degree", "network_in_degree", "network_out_strength", "network_in_strength"]}
_NET_COLS = ", ".join(_zeros(p, c, {"max_customers_per_device": "1"}) for p, c in _NET.items())
NETWORK = f"""
WITH dv AS ({DEVICES}), bn AS ({BENEF}), dg AS ({DEGREES}),
ids AS (SELECT customer_id FROM dv UNION SELECT customer_id FROM bn UNION SELECT customer_id FROM dg)
SELECT ids.customer_id, {_NET_COLS} FROM ids LEFT JOIN dv USING (customer_id) LEFT JOIN bn USING (customer_id)
  LEFT JOIN dg USING (customer_id)"""


@query("behavioral_features", BEHAVIORAL, "tx ce")
def behavioral_features(t):
    return rounded(behavior.behavioral_features(t.transactions(), t.customer_events(), AS_OF))


@query("network_features", NETWORK, "tx fr")
def network_features(t):
    return rounded(network.network_features(t.transactions(), t.fraud_records(), AS_OF))


_PROFILE_COLS = ["customer_age", "account_age_days", "total_products_count", "credit_score_internal",
                 "is_pep", "income_bracket_encoded", "kyc_completion_score"]
_BEH_COLS = _TXN_COLS + _DIV_COLS + _CH_COLS + _DIG_COLS + _VEL_COLS
_NET_ALL = [c for cols in _NET.values() for c in cols]


@query("feature_vector", f"""
WITH p AS ({PROFILE}), b AS ({BEHAVIORAL}), n AS ({NETWORK})
SELECT p.*, {_zeros('b', _BEH_COLS)}, {_zeros('n', _NET_ALL, {'max_customers_per_device': '1'})}
FROM p LEFT JOIN b ON p.customer_id = b.customer_id LEFT JOIN n ON p.customer_id = n.customer_id""",
       "cust prod risk tx ce fr")
def feature_vector(t):
    """Profile, behavioural and network columns of every customer in one plan."""
    return rounded(registry.default_registry().feature_vector(inputs(t)))


@query("feature_vector_network_only", f"""
WITH n AS ({NETWORK}) SELECT c.customer_id, {_zeros('n', _NET_ALL, {'max_customers_per_device': '1'})}
FROM cust c LEFT JOIN n ON c.customer_id = n.customer_id""", "cust tx fr")
def feature_vector_network_only(t):
    return rounded(registry.default_registry().feature_vector(inputs(t), ["network"]))


@query("feature_catalog")
def feature_catalog(t):
    """Every feature of the four pillars with its definition, and how many rows carry a value."""
    reg, given = registry.default_registry(), inputs(t)
    rows = [(d.name, d.pillar, d.data_type, d.description, ",".join(d.dependencies), d.ttl_seconds, d.refresh)
            for d in reg.definitions(given)]
    known = t.spark.createDataFrame(rows, "feature string, pillar string, data_type string, description string, "
                                          "dependencies string, ttl_seconds int, refresh string")
    counts = None
    for pillar in reg.pillars:
        wide = reg.build(pillar, given)
        names = [c for c in wide.columns if c not in ("customer_id", "transaction_id")]
        sums = wide.agg(*[F.count_if(F.expr(f"try_cast(cast(`{c}` AS string) AS double)") != 0).alias(c) for c in names])
        part = sums.unpivot([], names, "feature", "rows_with_value").withColumn("pillar", F.lit(pillar))
        counts = part if counts is None else counts.unionByName(part)
    return known.join(counts, ["pillar", "feature"])


@query("feature_table_long", f"""
WITH v AS ({TXN_WINDOWS}), l AS (UNPIVOT v ON COLUMNS(* EXCLUDE customer_id) INTO NAME c VALUE x)
SELECT customer_id, regexp_extract(c, '^(.*)_([^_]+)$', 1) AS feature_name, regexp_extract(c, '^(.*)_([^_]+)$', 2) AS time_window,
  round(CAST(x AS DOUBLE), 4) AS feature_value FROM (
  SELECT customer_id, c, x FROM (SELECT customer_id, unnest([{', '.join(f"'{c}'" for c in _TXN_COLS)}]) AS c,
    unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in _TXN_COLS)}]) AS x FROM v))""".replace(
    ", l AS (UNPIVOT v ON COLUMNS(* EXCLUDE customer_id) INTO NAME c VALUE x)", ""), "tx")
def feature_table_long(t):
    """Behavioural columns in long form: customer, feature, window, value."""
    wide = behavior.transaction_windows(t.transactions(), AS_OF)
    return rounded(registry.to_long(wide))


@query("validated_transactions", f"""
SELECT event_id AS transaction_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'USD' END, 'BRL') AS currency,
  CASE WHEN user_id % 29 = 0 THEN 'missing_customer_id'
    WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'amount_not_positive'
    WHEN event_id % 19 = 0 THEN 'unknown_product' END AS reject_reason,
  coalesce(CASE WHEN event_id % 23 <> 0 THEN ts END, {ASOF_SQL}) AS timestamp FROM events""")
def validated_transactions(t):
    """Incoming rows with broken fields are marked with a reason; defaults fill the rest."""
    e = F.col("transaction_id")
    raw = t.transactions().select(
        "transaction_id", F.when(F.col("customer_id") % 29 != 0, F.col("customer_id")).alias("customer_id"),
        F.when(e % 17 == 0, F.lit(None)).when(e % 13 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        F.when(e % 19 == 0, "barter").otherwise(F.col("product_type")).alias("product_type"),
        "channel", F.when(e % 3 == 0, "USD").alias("currency"),
        F.when(e % 23 != 0, F.col("timestamp")).alias("timestamp"))
    marked = tables.mark_invalid(raw, AS_OF)
    return marked.select("transaction_id", "currency", "reject_reason", "timestamp")


@query("source_read", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders "
       "WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def source_read(t):
    """A table by name with filter and column choice pushed to the scan."""
    return rounded(t.raw("orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
                   .groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))


@query("json_feature_map", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f_k, "
       "CAST(NULL AS DOUBLE) AS f_missing FROM events")
def json_feature_map(t):
    return tables.flatten_feature_map(t.raw("events").select("event_id", "props"), "props", ["k", "missing"], "f_")


@query("json_summary", """
SELECT '{"total":' || count(*) || ',"errors":' || count(*) FILTER (WHERE event_type = 'error')
  || ',"users":' || count(DISTINCT user_id) || '}' AS summary FROM events""")
def json_summary(t):
    return tables.json_summary(t.raw("events"), {
        "total": F.count(F.lit(1)), "errors": F.count_if(F.col("event_type") == "error"),
        "users": F.count_distinct("user_id")})


@query("value_counts", """
SELECT 'product_type' AS column_name, product_type AS value, count(*) AS n FROM tx GROUP BY 2
UNION ALL SELECT 'channel', channel, count(*) FROM tx GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM tx GROUP BY 2""", "tx")
def value_counts(t):
    return tables.value_counts(t.transactions(), ["product_type", "channel", "status"])
