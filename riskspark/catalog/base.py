"""Query registry and the SQL text of the canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.session import prepare
from riskspark.sources.driver import AS_OF, DriverTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 4


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column, so that the order of a sum does not show.

    Values are first snapped to eight places: a tie at the fifth place then
    falls the same way whatever noise the summation left.
    """
    scale = 10 ** digits

    def rounding(name: str):
        snapped = f"rint(`{name}` * 1e8D) / 1e8D"
        return F.expr(f"signum({snapped}) * floor(abs({snapped}) * {scale}D + 0.5D) / {scale}D + 0D AS `{name}`")

    return df.select(*[
        rounding(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def snap_rounding(sql: str) -> str:
    """The same two-step rounding on the SQL side: ``round(x, 4)`` snaps x first."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = snap_rounding(sql[j + 6:k - 1])
        if inner.rstrip().endswith(", 4"):
            inner = f"round({inner.rstrip()[:-3]}, 8), 4"
        out.append(sql[i:j] + "round(" + inner + ")")
        i = k


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` names the canonical tables its SQL reads."""
    def wrap(fn: Callable[[DriverTables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(DriverTables(spark, folder))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = snap_rounding(with_ctes(sql, ctes.split()))
        return fn
    return wrap


def with_ctes(sql: str, names: list[str]) -> str:
    needed: list[str] = []

    def need(n: str) -> None:
        for dep in CTE_DEPS.get(n, ()):
            need(dep)
        if n not in needed:
            needed.append(n)

    for n in names:
        need(n)
    if not needed:
        return sql.strip()
    body = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    text = sql.strip()
    if text[:4].upper() == "WITH":
        rest = text[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return f"WITH RECURSIVE {body},\n{rest[9:].lstrip()}"
        return f"WITH {body},\n{rest}"
    return f"WITH {body}\n{text}"


ASOF_SQL = f"TIMESTAMP '{AS_OF}'"

CTES = {
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "tx": """
SELECT event_id AS transaction_id, user_id AS customer_id,
  ['pix','pix','credit_card','ted','loan'][event_id % 5 + 1] AS product_type,
  ['transfer','transfer','purchase','transfer','loan_payment'][event_id % 5 + 1] AS transaction_type,
  value AS amount,
  CASE WHEN event_id % 5 IN (0,1,3) THEN
    CASE WHEN k < 10 THEN (user_id // 5) * 5 + k % 5 ELSE (user_id * 31 + k * 17) % 150 END END AS beneficiary_id,
  CASE WHEN event_id % 5 = 2 THEN ['5411','5541','5812','7995','5999'][k % 5 + 1] END AS merchant_category,
  ['mobile_app','web_browser','atm','pos'][event_id % 4 + 1] AS channel,
  CASE WHEN k < 2 THEN 'RING_' || lpad(CAST(user_id // 5 AS VARCHAR), 6, '0')
       WHEN k <> 99 THEN 'DEV_' || lpad(CAST(user_id * 3 + k % 3 AS VARCHAR), 6, '0') END AS device_id,
  '10.0.' || CAST(k % 16 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS ip_address,
  CASE WHEN event_id % 7 <> 0 THEN CAST(-23.5 AS DOUBLE) + (k % 10) * CAST(0.05 AS DOUBLE) END AS location_lat,
  CASE WHEN event_id % 7 <> 0 THEN CAST(-46.6 AS DOUBLE) + (k % 7) * CAST(0.05 AS DOUBLE) END AS location_lon,
  ts AS timestamp,
  CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END AS status, k
FROM ev""",
    "ce": """
SELECT event_id, user_id AS customer_id, ts AS timestamp,
  CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'password_change'
    WHEN 'view' THEN 'profile_update' WHEN 'click' THEN 'login' WHEN 'purchase' THEN 'logout' END AS event_type,
  value AS session_duration_minutes FROM events""",
    "fl": """
SELECT event_id AS transaction_id, user_id AS customer_id,
  CASE WHEN value > 150 OR k < 2 THEN 1 ELSE 0 END AS is_fraud,
  ts + INTERVAL 1 DAY AS label_timestamp,
  CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence_score FROM ev""",
    "sc": """
SELECT event_id AS transaction_id, (k * 7 % 100) / 100 AS hub_score,
  (event_id * 13 % 101) / 100 AS spoke_score FROM ev""",
    "cust": """
SELECT c_custkey AS customer_id, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS document_number,
  c_name AS full_name, DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS birth_date,
  CASE WHEN c_custkey % 7 <> 0 THEN 'u' || c_custkey || '@x.test' END AS email,
  lpad(CAST(c_custkey * 97 AS VARCHAR), 11, '0') AS phone,
  CASE WHEN c_custkey % 5 <> 0 THEN 'nation ' || c_nationkey END AS address,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'low' WHEN 'AUTOMOBILE' THEN 'medium'
    WHEN 'MACHINERY' THEN 'high' END AS income_bracket,
  c_acctbal > 0 AS income_verified,
  CASE WHEN c_custkey % 97 = 3 THEN 'closed' ELSE 'active' END AS status,
  CAST(DATE '2015-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) AS TIMESTAMP) AS created_at,
  CAST(DATE '2015-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) AS TIMESTAMP) AS updated_at,
  c_acctbal AS account_balance FROM customer""",
    "ident": r"""
SELECT source_system, customer_id, regexp_replace(document_number, '\D', '', 'g') AS document_number,
  regexp_replace(trim(upper(full_name)), '\s+', ' ', 'g') AS full_name, birth_date,
  trim(lower(email)) AS email, regexp_replace(phone, '\D', '', 'g') AS phone, created_at, updated_at
FROM (
  SELECT 'core_banking' AS source_system, customer_id, document_number, full_name, birth_date,
    email, phone, created_at, updated_at FROM cust WHERE status = 'active'
  UNION ALL
  SELECT 'credit_cards', c_custkey + 1000000, lpad(CAST(c_custkey AS VARCHAR), 11, '0'),
    replace(lower(c_name), '#', ' # '), DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER),
    'U' || c_custkey || '@X.TEST', lpad(CAST(c_custkey * 97 AS VARCHAR), 11, '0'),
    CAST(DATE '2015-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) AS TIMESTAMP),
    CAST(DATE '2015-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) + 1 AS TIMESTAMP)
  FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 21 <> 0
  UNION ALL
  SELECT 'loans', c_custkey + 2000000, lpad(CAST(c_custkey AS VARCHAR), 11, '0'), c_name,
    DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 + CASE WHEN c_custkey % 10 = 0 THEN 4000 ELSE 0 END AS INTEGER),
    NULL, lpad(CAST(c_custkey * 97 AS VARCHAR), 11, '0'),
    CAST(DATE '2015-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) AS TIMESTAMP),
    CAST(DATE '2015-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) + 2 AS TIMESTAMP)
  FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 35 <> 0)""",
    "prod": """
SELECT o_orderkey AS account_id, o_custkey AS customer_id,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'loan' WHEN '2' THEN 'credit_card' WHEN '3' THEN 'investment'
    WHEN '4' THEN 'checking_account' WHEN '5' THEN 'savings_account' END AS product_type,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' WHEN 'P' THEN 'suspended' END AS status,
  o_totalprice AS balance, o_orderdate AS opened_date, last_activity
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_activity FROM lineitem GROUP BY 1)
  ON o_orderkey = l_orderkey""",
    "risk": """
SELECT c_custkey AS customer_id, CAST(300 + c_custkey * 53 % 551 AS INTEGER) AS credit_score_internal,
  c_custkey % 50 = 0 AS is_pep FROM customer""",
    "ind": """
SELECT c_custkey AS customer_id, 'pep' AS indicator_type, 1.0::DOUBLE AS indicator_value FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT c_custkey, 'fraud_history', 1.0 FROM customer WHERE c_custkey % 40 = 0
UNION ALL SELECT c_custkey, 'credit_score_internal', 300 + c_custkey * 53 % 551 FROM customer
UNION ALL SELECT c_custkey, 'credit_score_external', 310 + c_custkey * 29 % 541 FROM customer WHERE c_custkey % 2 = 0""",
    "fr": "SELECT c_custkey AS customer_id FROM customer WHERE c_custkey % 40 = 0",
    "demo": """
SELECT c_custkey AS customer_id, 18 + c_custkey * 13 % 63 AS age, c_acctbal * 12 + 20000 AS income,
  300 + c_custkey * 53 % 551 AS credit_score, 1 + c_custkey * 11 % 3000 AS account_age_days,
  CAST(CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS is_pep,
  CAST(CASE WHEN c_nationkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS high_risk_location FROM customer""",
    "mp": """
SELECT event_id AS point_id, event_type AS name, ts AS timestamp, value,
  ['mobile_app','web_browser','atm','pos'][event_id % 4 + 1] AS channel FROM events""",
    "trade": """
SELECT 'C' || o_custkey AS customer_id, 'S' || l_suppkey AS beneficiary_id, l_extendedprice AS amount,
  o_orderdate AS timestamp FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
}
CTE_DEPS = {"tx": ["ev"], "fl": ["ev"], "sc": ["ev"], "ident": ["cust"]}


def fixed(x: str, places: int, plus: str = "") -> str:
    """SQL text of a number with so many places, halves away from zero by its shortest decimal form, as the JVM prints it."""
    digits = f"CAST(CAST(CAST(abs({x}) AS VARCHAR) AS DECIMAL(38,20)) AS DECIMAL(38,{places}))::VARCHAR"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '{plus}' END || {digits})"
