"""Identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalog.base import ASOF_SQL, query, rounded
from riskspark.catalog.features import AGE
from riskspark.operators import identity
from riskspark.plans.fixpoint import cut
from riskspark.sources.driver import AS_OF


def sources(t):
    return {"core_banking": t.customers(), "credit_cards": t.card_customers(), "loans": t.loan_applications()}


def identities(t):
    return identity.clean_identities(sources(t))


def mapping(t, mode="components"):
    return identity.resolve(identities(t), fuzzy="edit", mode=mode)


def _ratio(a: str, b: str) -> str:
    return f"(1 - levenshtein(lower(CAST({a} AS VARCHAR)), lower(CAST({b} AS VARCHAR))) / greatest(length(CAST({a} AS VARCHAR)), length(CAST({b} AS VARCHAR))))"


PAIRS = f"""
SELECT id_a, id_b, (1.0 + CASE WHEN e = 1 THEN 0.8 ELSE 0 END + CASE WHEN p = 1 THEN 0.7 ELSE 0 END
    + CASE WHEN nb >= 0.85 THEN nb * 0.9 ELSE 0 END + CASE WHEN np >= 0.80 THEN np * 0.8 ELSE 0 END)::DOUBLE
  / (1.0 + CASE WHEN e IS NULL THEN 0 ELSE 0.8 END + 0.7 + 0.9 + 0.8)::DOUBLE AS score
FROM (SELECT a.customer_id AS id_a, b.customer_id AS id_b, (a.email = b.email)::INT AS e, (a.phone = b.phone)::INT AS p,
    ({_ratio('a.full_name', 'b.full_name')} + {_ratio('a.birth_date', 'b.birth_date')}) / 2 AS nb,
    ({_ratio('a.full_name', 'b.full_name')} + {_ratio('a.phone', 'b.phone')}) / 2 AS np
  FROM ident a JOIN ident b ON a.document_number = b.document_number AND a.customer_id < b.customer_id)"""

MAPPING = f"""
WITH RECURSIVE pr AS (SELECT * FROM ({PAIRS}) WHERE score >= 0.8::DOUBLE),
ed AS (SELECT id_a AS a, id_b AS b FROM pr UNION SELECT id_b, id_a FROM pr),
rc(id, root) AS (SELECT customer_id, customer_id FROM ident UNION SELECT ed.b, rc.root FROM rc JOIN ed ON ed.a = rc.id)
SELECT id AS customer_id, min(root) AS canonical_customer_id FROM rc GROUP BY 1"""


@query("identities_clean", "SELECT * FROM ident", "ident")
def identities_clean(t):
    """Three sources in one shape, filtered by state, standardised, one row per id and source."""
    return identities(t)


@query("identity_pair_scores", f"SELECT id_a, id_b, round(score, 4) AS score FROM ({PAIRS}) WHERE score >= 0.8::DOUBLE", "ident")
def identity_pair_scores(t):
    """Pairs reaching the match score under the edit-distance variant."""
    return rounded(identity.matched_pairs(identities(t), fuzzy="edit"))


@query("identity_pairs_matcher")
def identity_pairs_matcher(t):
    """The same with sequence matching, which SQL cannot express."""
    return rounded(identity.matched_pairs(identities(t), fuzzy="matcher"))


def _passes(name: str) -> str:
    return f"CASE WHEN coalesce(a.{name}, '') = '' OR coalesce(b.{name}, '') = '' OR a.{name} = b.{name} THEN 1 ELSE 0 END"


def _none(x: str) -> str:
    return f"coalesce(nullif(CAST({x} AS VARCHAR), ''), 'none')"


@query("identity_pair_scores_reference", f"""
SELECT id_a, id_b, round(score, 4) AS score FROM (
  SELECT id_a, id_b, (1.0 + 0.8 * e + 0.7 * p + CASE WHEN nb >= 0.85 THEN nb * 0.9 ELSE 0 END + CASE WHEN np >= 0.80 THEN np * 0.8 ELSE 0 END)::DOUBLE
    / 4.2::DOUBLE AS score
  FROM (SELECT a.customer_id AS id_a, b.customer_id AS id_b, {_passes('email')} AS e, {_passes('phone')} AS p,
    ({_ratio(_none('a.full_name'), _none('b.full_name'))} + {_ratio(_none('a.birth_date'), _none('b.birth_date'))}) / 2 AS nb,
    ({_ratio(_none('a.full_name'), _none('b.full_name'))} + {_ratio(_none('a.phone'), _none('b.phone'))}) / 2 AS np
    FROM ident a JOIN ident b ON a.document_number = b.document_number AND a.customer_id < b.customer_id))
WHERE score >= 0.8::DOUBLE""", "ident")
def identity_pair_scores_reference(t):
    """Pairs reaching the match score where an empty side passes an exact rule."""
    return rounded(identity.matched_pairs(identities(t), fuzzy="edit", null_policy="reference"))


@query("customer_id_mapping", MAPPING, "ident")
def customer_id_mapping(t):
    return mapping(t)


@query("customer_id_mapping_seed", f"""
WITH pr AS (SELECT * FROM ({PAIRS}) WHERE score >= 0.8::DOUBLE)
SELECT i.customer_id, coalesce(min(pr.id_a), i.customer_id) AS canonical_customer_id
FROM ident i LEFT JOIN pr ON pr.id_b = i.customer_id AND pr.id_a NOT IN (SELECT id_b FROM pr) GROUP BY i.customer_id""", "ident")
def customer_id_mapping_seed(t):
    """Grouping around seeds: members match the smallest id directly."""
    return mapping(t, mode="seed")


@query("canonical_lookup", f"""
WITH m AS ({MAPPING})
SELECT p.account_id, p.customer_id, coalesce(m.canonical_customer_id, p.customer_id) AS canonical_customer_id
FROM prod p LEFT JOIN m USING (customer_id)""", "ident prod")
def canonical_lookup(t):
    return identity.canonical_lookup(t.customer_products().select("account_id", "customer_id"), mapping(t))


@query("related_ids", f"""
WITH m AS ({MAPPING}) SELECT a.customer_id, b.customer_id AS related_customer_id
FROM m a JOIN m b USING (canonical_customer_id) WHERE a.customer_id IN (SELECT customer_id FROM fr)""", "ident fr")
def related_ids(t):
    m = cut(mapping(t))
    return identity.related_ids(t.fraud_records(), m)


@query("membership_filter", "SELECT account_id, customer_id FROM prod WHERE customer_id IN (SELECT customer_id FROM fr)", "prod fr")
def membership_filter(t):
    return identity.only_customers(t.customer_products(), t.fraud_records()).select("account_id", "customer_id")


BEST = """
SELECT canonical_customer_id, document_number, full_name, birth_date, email, phone, created_at, updated_at FROM (
  SELECT i.*, m.canonical_customer_id, row_number() OVER (PARTITION BY m.canonical_customer_id
    ORDER BY email IS NULL, phone IS NULL, updated_at DESC NULLS LAST, i.customer_id, source_system) AS rn
  FROM ident i JOIN m USING (customer_id)) WHERE rn = 1"""


@query("best_identity", f"WITH m AS ({MAPPING}) {BEST}", "ident")
def best_identity(t):
    return identity.best_identity(identities(t), mapping(t))


CP = "(SELECT p.*, coalesce(m.canonical_customer_id, p.customer_id) AS cid FROM prod p LEFT JOIN m USING (customer_id))"
PRIMARY = f"""
SELECT cid AS canonical_customer_id, product_type AS primary_product FROM (SELECT *, row_number() OVER (PARTITION BY cid
  ORDER BY last_activity DESC NULLS LAST, balance DESC, account_id) AS rn FROM {CP} WHERE status = 'active') WHERE rn = 1"""
ROLLUP = f"""
SELECT cid AS canonical_customer_id, count(*) AS total_products,
  coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN status = 'active' THEN product_type END)), ','), '') AS active_products,
  count(*) FILTER (WHERE status = 'active') AS active_count,
  min(opened_date) AS customer_since, max(last_activity) AS last_activity,
  CAST(floor((epoch_us({ASOF_SQL}) - epoch_us(min(opened_date))) / 86400000000) AS BIGINT) AS relationship_length_days
FROM {CP} GROUP BY 1"""
INDIC = """
SELECT coalesce(m.canonical_customer_id, i.customer_id) AS canonical_customer_id, bool_or(indicator_type = 'pep') AS is_pep,
  bool_or(indicator_type = 'fraud_history') AS has_fraud_history,
  CAST(floor(avg(CASE WHEN indicator_type = 'credit_score_internal' THEN indicator_value END)) AS BIGINT) AS credit_score_internal,
  CAST(floor(avg(CASE WHEN indicator_type = 'credit_score_external' THEN indicator_value END)) AS BIGINT) AS credit_score_external
FROM ind i LEFT JOIN m USING (customer_id) GROUP BY 1"""


def _flat(rollup):
    return rollup.withColumn("active_count", F.aggregate(F.map_values("active_product_counts"), F.lit(0).cast("bigint"),
                                                         lambda a, x: a + x)) \
        .withColumn("active_products", F.array_join("active_products", ",")).drop("active_product_counts")


@query("primary_product", f"WITH m AS ({MAPPING}) {PRIMARY}", "ident prod")
def primary_product(t):
    return identity.primary_product(t.customer_products(), mapping(t))


@query("product_rollup", f"WITH m AS ({MAPPING}) {ROLLUP}", "ident prod")
def product_rollup(t):
    return _flat(identity.product_rollup(t.customer_products(), mapping(t), AS_OF))


@query("days_since_opening", f"SELECT account_id, CAST(floor((epoch_us({ASOF_SQL}) - epoch_us(opened_date)) / 86400000000) AS BIGINT) AS days_since_opening FROM prod", "prod")
def days_since_opening(t):
    return identity.days_since_opening(t.customer_products(), AS_OF).select("account_id", "days_since_opening")


@query("risk_indicators", f"WITH m AS ({MAPPING}) {INDIC}", "ident ind")
def risk_indicators(t):
    return identity.risk_indicators(t.risk_indicators(), mapping(t))


UNIFIED = f"""
WITH m AS ({MAPPING}), b AS ({BEST}), r AS ({ROLLUP}), p AS ({PRIMARY}), i AS ({INDIC})
SELECT b.*, coalesce(total_products, 0) AS total_products, active_products, active_count, customer_since, last_activity,
  relationship_length_days, primary_product, coalesce(is_pep, false) AS is_pep,
  coalesce(has_fraud_history, false) AS has_fraud_history, credit_score_internal, credit_score_external, {AGE} AS age
FROM b LEFT JOIN r USING (canonical_customer_id) LEFT JOIN p USING (canonical_customer_id) LEFT JOIN i USING (canonical_customer_id)"""


@query("unified_profiles", UNIFIED, "ident prod ind")
def unified_profiles(t):
    m = cut(mapping(t))
    return _flat(identity.unified_profiles(identities(t), m, t.customer_products(), t.risk_indicators(), AS_OF))


@query("unified_profiles_refreshed", UNIFIED, "ident prod ind")
def unified_profiles_refreshed(t):
    """Profiles of known fraudsters rebuilt inside a stored table give the same table."""
    m = cut(mapping(t))
    stored = cut(identity.unified_profiles(identities(t), m, t.customer_products(), t.risk_indicators(), AS_OF))
    return _flat(identity.refresh_profiles(stored, t.fraud_records(), identities(t), m, t.customer_products(),
                                           t.risk_indicators(), AS_OF))
