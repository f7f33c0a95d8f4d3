"""Time-series queries."""

from __future__ import annotations

from riskspark.catalog.base import ASOF_SQL, query, rounded
from riskspark.operators import temporal
from riskspark.sources.driver import AS_OF

R = temporal.ROLLING
UNTIL = f"tx WHERE timestamp <= {ASOF_SQL}"

RECENCY = f"""
WITH g AS (SELECT customer_id, timestamp, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER
    (PARTITION BY customer_id ORDER BY timestamp, transaction_id))) / 3600000000 AS gap FROM {UNTIL}),
s AS (SELECT customer_id, min(timestamp) AS a, max(timestamp) AS b, count(*) AS n, avg(gap) AS av, stddev_samp(gap) AS sd,
  min(gap) AS mi, max(gap) AS ma, quantile_cont(gap, 0.5) AS me FROM g GROUP BY 1)
SELECT customer_id, (epoch_us({ASOF_SQL}) - epoch_us(a)) // 86400000000 AS days_since_first_transaction,
  (epoch_us({ASOF_SQL}) - epoch_us(b)) // 86400000000 AS days_since_last_transaction,
  (epoch_us(b) - epoch_us(a)) // 86400000000 AS account_activity_span_days,
  round(n / greatest((epoch_us(b) - epoch_us(a)) // 86400000000, 1), 4) AS avg_transactions_per_day,
  round(coalesce(av, 0), 4) AS avg_inter_transaction_hours, round(coalesce(sd, 0), 4) AS std_inter_transaction_hours,
  round(coalesce(mi, 0), 4) AS min_inter_transaction_hours, round(coalesce(ma, 0), 4) AS max_inter_transaction_hours,
  round(coalesce(me, 0), 4) AS median_inter_transaction_hours FROM s"""


def _rolling() -> str:
    cols = []
    for w, h in R.items():
        c = f"FILTER (WHERE timestamp >= {ASOF_SQL} - INTERVAL {h} HOUR)"
        cols.append(f'count(*) {c} AS "{w}_transaction_count"')
        cols += [f'round(coalesce({f}(amount) {c}, 0), 4) AS "{w}_{n}_amount"' for n, f in
                 (("total", "sum"), ("avg", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))]
        cols += [f'count(DISTINCT {e}) {c} AS "{w}_unique_{n}"' for n, e in
                 (("products", "product_type"), ("channels", "channel"), ("beneficiaries", "beneficiary_id"))]
        cols.append(f'round(1 - count(DISTINCT beneficiary_id) {c} / greatest(count(*) {c}, 1), 4) AS "{w}_repeat_beneficiary_rate"')
    return f"SELECT customer_id, {', '.join(cols)} FROM {UNTIL} GROUP BY 1"


ROLLING = _rolling()


def _velocity() -> str:
    n = {w: f"(count(*) FILTER (WHERE timestamp >= {ASOF_SQL} - INTERVAL {h} HOUR)) / {h}.0::DOUBLE" for w, h in R.items()}
    cols = [f'round({n[w]}, 4) AS "velocity_txn_per_hour_{w}"' for w in temporal.VELOCITY]
    cols += [f'round(coalesce(sum(amount) FILTER (WHERE timestamp >= {ASOF_SQL} - INTERVAL {R[w]} HOUR), 0) / {R[w]}.0::DOUBLE, 4) '
             f'AS "velocity_amount_per_hour_{w}"' for w in temporal.VELOCITY]
    cols += [f'round({n[b]} - {n[a]}, 4) AS "acceleration_txn_{a}_to_{b}"' for a, b in zip(temporal.VELOCITY, temporal.VELOCITY[1:])]
    return f"SELECT customer_id, {', '.join(cols)} FROM {UNTIL} GROUP BY 1"


VELOCITY = _velocity()


def _filled(unit: str, step: str) -> str:
    return f"""
SELECT g.customer_id, g.bucket, coalesce(n, 0) AS n, coalesce(total, 0)::DOUBLE AS total FROM (
  SELECT customer_id, unnest(generate_series(min(date_trunc('{unit}', timestamp))::TIMESTAMP, max(date_trunc('{unit}', timestamp))::TIMESTAMP, INTERVAL 1 {step})) AS bucket
  FROM {UNTIL} GROUP BY 1) g LEFT JOIN (SELECT customer_id, date_trunc('{unit}', timestamp)::TIMESTAMP AS bucket, count(*) AS n,
  sum(amount) AS total FROM {UNTIL} GROUP BY 1, 2) USING (customer_id, bucket)"""


DAYS = _filled("day", "DAY")
HOURS = _filled("hour", "HOUR")

PERIODS = f"""
WITH b AS (SELECT customer_id, date_trunc('hour', timestamp) AS bucket, count(*) AS n FROM {UNTIL} GROUP BY 1, 2),
c AS (SELECT customer_id, sum(n) AS rws, min(bucket) AS a, CAST(date_diff('hour', min(bucket), max(bucket)) + 1 AS BIGINT) AS len FROM b GROUP BY 1),
k AS (SELECT customer_id, a, len, unnest(range(1, len // 2)) AS f FROM c WHERE rws >= 10 AND len >= 24),
p AS (SELECT k.customer_id, f, len, power(sum(n * cos(2 * pi() * f * date_diff('hour', a, bucket) / len)), 2)
    + power(sum(n * sin(2 * pi() * f * date_diff('hour', a, bucket) / len)), 2) AS pw
  FROM k JOIN b ON b.customer_id = k.customer_id GROUP BY 1, 2, 3),
m AS (SELECT customer_id, first(len / f ORDER BY round(pw, 6) DESC, f) AS per, max(pw) / sum(pw) AS conc FROM p GROUP BY 1)
SELECT c.customer_id, round(coalesce(per, 0), 4) AS fourier_dominant_period_hours,
  round(coalesce(conc, 0), 4) AS fourier_power_concentration FROM c LEFT JOIN m USING (customer_id)"""

CHANGES = f"""
WITH d AS ({DAYS}), t AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY bucket) - 1 AS t,
    count(*) OVER c AS days, sum(n) OVER c AS rws, avg(total) OVER c AS mean FROM d WINDOW c AS (PARTITION BY customer_id)),
s AS (SELECT *, sum(CASE WHEN t > 0 THEN total - mean - 0.5::DOUBLE ELSE 0 END) OVER u AS p,
    sum(CASE WHEN t > 0 THEN total - mean + 0.5::DOUBLE ELSE 0 END) OVER u AS q FROM t
    WINDOW u AS (PARTITION BY customer_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, p - min(p) OVER u AS up, max(q) OVER u - q AS down FROM s
    WINDOW u AS (PARTITION BY customer_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, t >= 1 AND t <= days - 2 AND days >= 5 AND (up > 5 OR down > 5) AS hit FROM a),
g AS (SELECT customer_id, count(*) FILTER (WHERE hit) AS hits, max(t) FILTER (WHERE hit) AS lst, any_value(days) AS days,
    any_value(rws) AS rws FROM h GROUP BY 1)
SELECT customer_id, CASE WHEN rws >= 20 THEN hits ELSE 0 END AS changepoints_detected,
  CASE WHEN rws < 20 THEN 0 WHEN hits > 0 THEN days - 1 - lst ELSE days END AS time_since_last_changepoint_days FROM g"""

HABITS = f"""
WITH h AS (SELECT customer_id, hour(timestamp) AS h, count(*) AS n, count(*) FILTER (WHERE isodow(timestamp) >= 6) AS we
  FROM {UNTIL} GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY customer_id) AS p FROM h)
SELECT customer_id, round(sum(CASE WHEN h BETWEEN 9 AND 17 THEN n ELSE 0 END) / sum(n), 4) AS business_hours_ratio,
  round(1 - sum(CASE WHEN h BETWEEN 9 AND 17 THEN n ELSE 0 END) / sum(n), 4) AS non_business_hours_ratio,
  round(sum(we) / sum(n), 4) AS weekend_ratio, round(1 - sum(we) / sum(n), 4) AS weekday_ratio,
  round(-sum(p * log2(p + 1e-8)), 4) AS hour_entropy, CAST(first(h ORDER BY n DESC, h) AS INTEGER) AS most_active_hour,
  max(n) AS most_active_hour_count FROM s GROUP BY 1"""

CLASSICAL = f"""
WITH d AS (SELECT * FROM ({DAYS})),
a AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY bucket) - 1 AS t, n::DOUBLE AS x,
  count(*) OVER (PARTITION BY customer_id) AS days FROM d),
b AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(x) OVER w END AS trend FROM a WHERE days >= 30
  WINDOW w AS (PARTITION BY customer_id ORDER BY bucket ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
c AS (SELECT *, avg(x - trend) OVER (PARTITION BY customer_id, t % 7) AS raw FROM b),
e AS (SELECT *, raw - avg(raw) OVER (PARTITION BY customer_id) AS se FROM c)
SELECT customer_id, round(CASE WHEN var_pop(x) > 0 THEN var_pop(se) / var_pop(x) ELSE 0 END, 4) AS seasonal_strength,
  round(CASE WHEN var_pop(x) > 0 THEN var_pop(trend) / var_pop(x) ELSE 0 END, 4) AS trend_strength,
  round(CASE WHEN var_pop(x) > 0 THEN var_pop(x - trend - se) / var_pop(x) ELSE 0 END, 4) AS remainder_strength,
  round(regr_slope(trend, t), 4) AS trend_slope,
  round(1 - stddev_pop(se) / (avg(abs(se)) + 1e-8), 4) AS seasonal_consistency FROM e GROUP BY 1"""


def upto(t):
    return temporal.until(t.transactions(), AS_OF)


@query("recency_frequency", RECENCY, "tx")
def recency_frequency(t):
    return rounded(temporal.recency_frequency(t.transactions(), AS_OF))


@query("rolling_windows", ROLLING, "tx")
def rolling_windows(t):
    return rounded(temporal.rolling_windows(t.transactions(), AS_OF))


@query("velocity_acceleration", VELOCITY, "tx")
def velocity_acceleration(t):
    return rounded(temporal.velocity_acceleration(temporal.rolling_windows(t.transactions(), AS_OF)))


@query("daily_buckets", f"SELECT customer_id, bucket, n, round(total, 4) AS total FROM ({DAYS})", "tx")
def daily_buckets(t):
    return rounded(temporal.filled_buckets(upto(t), "day"))


@query("hourly_buckets", f"SELECT customer_id, bucket, n, round(total, 4) AS total FROM ({HOURS})", "tx")
def hourly_buckets(t):
    return rounded(temporal.filled_buckets(upto(t), "hour"))


@query("periodicity", PERIODS, "tx")
def periodicity(t):
    return rounded(temporal.periodicity(upto(t)))


@query("seasonality_local")
def seasonality_local(t):
    """Decomposition by local regression has no SQL form; its parts are tested apart."""
    return rounded(temporal.seasonality(upto(t)))


@query("seasonality_classical", CLASSICAL, "tx")
def seasonality_classical(t):
    return rounded(temporal.seasonality(upto(t), method="classical"))


@query("change_points", CHANGES, "tx")
def change_points(t):
    return temporal.change_points(upto(t))


@query("wavelets")
def wavelets(t):
    """Filter-bank energies have no short SQL form; invariants are tested apart."""
    return rounded(temporal.wavelets(upto(t)))


@query("habits", HABITS, "tx")
def habits(t):
    return rounded(temporal.habits(upto(t)))


def _columns(sql_names: list[str], part: str) -> str:
    return ", ".join(f'coalesce({part}."{c}", 0) AS "{c}"' for c in sql_names)


_REC = ["days_since_first_transaction", "days_since_last_transaction", "account_activity_span_days", "avg_transactions_per_day"] + [
    f"{x}_inter_transaction_hours" for x in ("avg", "std", "min", "max", "median")]
_ROLL = [f"{w}_{c}" for w in R for c in ("transaction_count", "total_amount", "avg_amount", "std_amount", "max_amount", "min_amount",
                                        "unique_products", "unique_channels", "unique_beneficiaries", "repeat_beneficiary_rate")]
_VEL = [f"velocity_{k}_per_hour_{w}" for k in ("txn", "amount") for w in temporal.VELOCITY] + [
    f"acceleration_txn_{a}_to_{b}" for a, b in zip(temporal.VELOCITY, temporal.VELOCITY[1:])]
_HAB = ["business_hours_ratio", "non_business_hours_ratio", "weekend_ratio", "weekday_ratio", "hour_entropy",
        "most_active_hour", "most_active_hour_count"]


@query("temporal_features", f"""
WITH a AS ({RECENCY}), b AS ({ROLLING}), v AS ({VELOCITY}), c AS ({CHANGES}), h AS ({HABITS})
SELECT cust.customer_id, {_columns(_REC, 'a')}, {_columns(_ROLL, 'b')}, {_columns(_VEL, 'v')},
  {_columns(['changepoints_detected', 'time_since_last_changepoint_days'], 'c')}, {_columns(_HAB, 'h')}
FROM cust LEFT JOIN a USING (customer_id) LEFT JOIN b USING (customer_id) LEFT JOIN v USING (customer_id)
  LEFT JOIN c USING (customer_id) LEFT JOIN h USING (customer_id)""", "tx cust")
def temporal_features(t):
    """Native time-series columns of every customer, zero where there is no data."""
    return rounded(temporal.temporal_features(t.customers(), t.transactions(), AS_OF, native_only=True))


@query("temporal_features_all")
def temporal_features_all(t):
    """The same with Fourier, seasonal and wavelet columns."""
    return rounded(temporal.temporal_features(t.customers(), t.transactions(), AS_OF))


def _anomalies(history: str) -> str:
    return f"""
WITH hist AS ({history}),
n AS (SELECT customer_id, count(*) AS rws FROM hist GROUP BY 1),
hh AS (SELECT customer_id, hour(timestamp) AS h, count(*) AS hn, avg(amount) AS hm, stddev_samp(amount) AS hs FROM hist GROUP BY 1, 2),
own AS (SELECT customer_id, count(*) OVER (PARTITION BY customer_id ORDER BY timestamp RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS c FROM hist),
base AS (SELECT customer_id, avg(c) AS m, stddev_pop(c) AS s FROM own GROUP BY 1),
cur AS (SELECT t.transaction_id, count(hist.timestamp) AS c FROM tx t LEFT JOIN hist ON hist.customer_id = t.customer_id
  AND hist.timestamp >= t.timestamp - INTERVAL 24 HOUR AND hist.timestamp <= t.timestamp GROUP BY 1)
SELECT t.transaction_id, round(CASE WHEN coalesce(rws, 0) < 5 THEN 0 ELSE 1 - coalesce(hn, 0) / rws END, 4) AS time_of_day_anomaly_score,
  round(CASE WHEN coalesce(rws, 0) < 10 OR NOT (s > 0) THEN 0 ELSE least(abs(cur.c + CASE WHEN t.transaction_id IN (SELECT transaction_id FROM hist) THEN 0 ELSE 1 END - m) / s / 3, 1) END, 4) AS frequency_anomaly_score,
  round(CASE WHEN coalesce(rws, 0) < 10 THEN 0 WHEN coalesce(hn, 0) = 0 THEN 1 WHEN hs > 0 THEN least(abs(amount - hm) / hs / 3, 1)
    WHEN amount = hm THEN 0 ELSE 1 END, 4) AS amount_timing_anomaly_score
FROM tx t LEFT JOIN n USING (customer_id) LEFT JOIN base USING (customer_id) JOIN cur ON cur.transaction_id = t.transaction_id
LEFT JOIN hh ON hh.customer_id = t.customer_id AND hh.h = hour(t.timestamp)"""


@query("temporal_anomalies", _anomalies("SELECT * FROM tx"), "tx")
def temporal_anomalies(t):
    return rounded(temporal.temporal_anomalies(t.transactions(), t.transactions()))


@query("temporal_anomalies_earlier_history", _anomalies("SELECT * FROM tx WHERE timestamp <= TIMESTAMP '2024-01-10'"), "tx")
def temporal_anomalies_earlier_history(t):
    """All transactions against the history known on an earlier date."""
    return rounded(temporal.temporal_anomalies(t.transactions(), temporal.until(t.transactions(), "2024-01-10")))
