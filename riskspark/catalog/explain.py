"""Explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalog.base import fixed, query, rounded
from riskspark.catalog.decisions import labelled_scores
from riskspark.operators import explain, modeling_table, models, training
from riskspark.plans.fixpoint import cut

WEIGHTS = {"age": -0.002, "income": 0.000004, "credit_score": -0.0006, "account_age_days": -0.00005, "is_pep": 0.25,
           "high_risk_location": 0.12}
FEATURES = list(WEIGHTS)

LINEAR = " UNION ALL ".join(
    f"SELECT customer_id, '{f}' AS feature, {f}::DOUBLE AS value, {w:.6f}::DOUBLE * ({f} - (SELECT avg({f}) FROM demo)) AS attribution FROM demo"
    for f, w in WEIGHTS.items())


@query("linear_attributions", f"SELECT customer_id, feature, round(value, 4) AS value, round(attribution, 4) AS attribution FROM ({LINEAR})", "demo")
def linear_attributions(t):
    return rounded(explain.linear_attributions(t.demo_profiles(), "customer_id", WEIGHTS))


@query("global_importance", f"SELECT feature, round(avg(attribution), 4) AS importance, round(avg(abs(attribution)), 4) AS abs_importance FROM ({LINEAR}) GROUP BY 1", "demo")
def global_importance(t):
    return rounded(explain.global_importance(explain.linear_attributions(t.demo_profiles(), "customer_id", WEIGHTS)))


TEXTS = f"""
WITH l AS ({LINEAR}), r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(attribution) DESC, feature) AS i FROM l),
s AS (SELECT customer_id, sum(attribution) + 0.3::DOUBLE AS score, string_agg(feature, ',' ORDER BY i) FILTER (WHERE i <= 5) AS top_features,
  string_agg(i || '. **' || feature || '** = ' || {fixed("value", 3)} || CASE WHEN abs(attribution) > {explain.STRONG} THEN ' strongly '
    WHEN abs(attribution) > {explain.MODERATE} THEN ' moderately ' ELSE ' slightly ' END || CASE WHEN attribution > 0 THEN 'increases' ELSE 'decreases' END
    || ' fraud risk (impact: ' || {fixed("attribution", 3, "+")} || ')', chr(10) ORDER BY i) FILTER (WHERE i <= 5) AS factors FROM r GROUP BY 1)
SELECT customer_id, score, level, top_features,
  '**Risk Level: ' || level || '** (Score: ' || {fixed("score", 3)} || ')' || chr(10) || '**Key Factors:**' || chr(10) || factors AS text
FROM (SELECT *, CASE WHEN score > 0.5 THEN 'HIGH' WHEN score > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s)"""


@query("explanation_texts", f"SELECT * REPLACE (round(score, 4) AS score) FROM ({TEXTS})", "demo")
def explanation_texts(t):
    a = explain.linear_attributions(t.demo_profiles(), "customer_id", WEIGHTS)
    out = explain.explanation_texts(a, "customer_id", F.lit(0.3))
    return rounded(out.select("customer_id", "score", "level", F.array_join("top_features", ",").alias("top_features"), "text"))


CHANGES = """
SELECT customer_id, j AS rank, 'income' AS feature, income AS original, income - j * 1000 * (customer_id % 3) AS value FROM demo, (SELECT unnest([1,2,3]) AS j)
UNION ALL SELECT customer_id, j, 'credit_score', credit_score, credit_score + (customer_id * j) % 4 * 10 FROM demo, (SELECT unnest([1,2,3]) AS j)"""


def given_changes(t):
    """Counterfactual values by formula, so that the analysis has an exact twin."""
    c, j = F.col("customer_id"), F.col("rank")
    base = t.demo_profiles().withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = F.array(
        F.struct(F.lit("income").alias("feature"), F.col("income").alias("original"), (F.col("income") - j * 1000 * (c % 3)).alias("value")),
        F.struct(F.lit("credit_score").alias("feature"), F.col("credit_score").cast("double").alias("original"),
                 (F.col("credit_score") + (c * j) % 4 * 10).cast("double").alias("value")))
    return base.select("customer_id", "rank", F.explode(rows).alias("r")).select("customer_id", "rank", "r.*")


ANALYSIS = f"""
SELECT customer_id, feature, count(*) FILTER (WHERE value <> original) / count(*) AS change_frequency, min(original)::DOUBLE AS original_value,
  avg(value - original) AS average_change, min(value - original)::DOUBLE AS min_change, max(value - original)::DOUBLE AS max_change
FROM ({CHANGES}) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE value <> original) > 0"""


@query("change_analysis", f"""SELECT customer_id, feature, round(change_frequency, 4) AS change_frequency, round(original_value, 4) AS original_value,
  round(average_change, 4) AS average_change, round(min_change, 4) AS min_change, round(max_change, 4) AS max_change FROM ({ANALYSIS})""", "demo")
def change_analysis(t):
    return rounded(explain.change_analysis(given_changes(t), "customer_id"))


@query("counterfactual_insights", f"""
SELECT customer_id, coalesce(string_agg('To change the prediction, consider ' || CASE WHEN average_change > 0 THEN 'increasing ' ELSE 'reducing ' END || feature,
  ';' ORDER BY change_frequency DESC, feature) FILTER (WHERE change_frequency > 0.5), '') AS advice FROM ({ANALYSIS}) GROUP BY 1""", "demo")
def counterfactual_insights(t):
    out = explain.insights(explain.change_analysis(given_changes(t), "customer_id"), "customer_id")
    return out.select("customer_id", F.array_join(F.transform("insights", lambda s: F.regexp_extract(s, "^(.*) from ", 1)), ";").alias("advice"))


class Fitted:
    """A small logistic model on customer attributes, shared by the model-based explanations."""

    _known: dict[tuple[str, str], "Fitted"] = {}

    def __init__(self, t):
        demo = t.demo_profiles()
        frauds = t.fraud_labels().groupBy("customer_id").agg(F.sum("is_fraud").alias("frauds"))
        c = F.col
        risk = modeling_table.base_risk(c("age"), c("income"), c("credit_score"), c("is_pep") == 1)
        rows = demo.join(frauds, "customer_id", "left").withColumn(
            "label", ((risk > 0.5) | (F.coalesce("frauds", F.lit(0)) > 6)).cast("int"))
        part = F.when(training.stable_fraction("customer_id") < 0.2, "test").otherwise("train")
        rows = rows.withColumn("part", part).select("customer_id", "label", "part", *FEATURES)
        self.trained = models.train_model(rows, FEATURES, models.Spec("customer_risk", "logistic"))
        self.background = cut(explain.background(demo, "customer_id", FEATURES))

    @classmethod
    def of(cls, t) -> "Fitted":
        key = (t.spark.sparkContext.applicationId, t.folder)
        if key not in cls._known:
            cls._known[key] = cls(t)
        return cls._known[key]


@query("sampled_attributions")
def sampled_attributions(t):
    """Shapley values of every customer's score; they add up to score minus base."""
    f = Fitted.of(t)
    return rounded(explain.sampled_attributions(f.trained.model, t.demo_profiles(), "customer_id", FEATURES, f.background))


@query("counterfactuals")
def counterfactuals(t):
    """Nearest changed versions of every customer that fall in the low-risk class."""
    f = Fitted.of(t)
    found = explain.counterfactuals(f.trained.model, t.demo_profiles(), "customer_id", FEATURES, t.demo_profiles())
    return rounded(explain.long_changes(found, "customer_id", FEATURES))


@query("local_surrogates")
def local_surrogates(t):
    f = Fitted.of(t)
    return rounded(explain.local_surrogates(f.trained.model, t.demo_profiles(), "customer_id", FEATURES, t.demo_profiles()))


@query("combined_explanations", f"""
WITH tx1 AS ({TEXTS}), ad AS (SELECT customer_id, string_agg('- To change the prediction, consider ' || CASE WHEN average_change > 0 THEN 'increasing ' ELSE 'reducing ' END
    || feature || ' from ' || {fixed("original_value", 3)} || ' (changed in ' || {fixed("change_frequency * 100", 1)} || '% of counterfactuals)', chr(10)
    ORDER BY change_frequency DESC, feature) FILTER (WHERE change_frequency > 0.5) AS advice FROM ({ANALYSIS}) GROUP BY 1)
SELECT customer_id, round(score, 4) AS score, (score > 0.5)::INT AS prediction,
  concat_ws(chr(10), '**Prediction:** ' || CASE WHEN score > 0.5 THEN 'FRAUD' ELSE 'NOT FRAUD' END || ' (Confidence: ' || {fixed("score * 100", 1)}
    || '%, Risk Level: ' || CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.3 THEN 'MEDIUM' ELSE 'LOW' END || ')', text,
    '**Actionable Recommendations:**' || chr(10) || advice, '{explain.COMPLIANCE}') AS summary
FROM tx1 LEFT JOIN ad USING (customer_id)""", "demo")
def combined_explanations(t):
    """Score, factors and advice of a row in one text."""
    a = explain.linear_attributions(t.demo_profiles(), "customer_id", WEIGHTS)
    texts = explain.explanation_texts(a, "customer_id", F.lit(0.3))
    advice = explain.insights(explain.change_analysis(given_changes(t), "customer_id"), "customer_id")
    out = explain.combined_explanations(texts.select("customer_id", "score"), "customer_id", texts, advice)
    return rounded(out.select("customer_id", "score", "prediction", "summary"))


@query("model_report_top_features", f"""
SELECT feature, round(avg(attribution), 4) AS importance, round(avg(abs(attribution)), 4) AS abs_importance FROM ({LINEAR}) GROUP BY 1
ORDER BY avg(abs(attribution)) DESC LIMIT 3""", "demo")
def model_report_top_features(t):
    """Top factors of the model report; its other tables are registered on their own."""
    a = explain.linear_attributions(t.demo_profiles(), "customer_id", WEIGHTS)
    return rounded(explain.model_report(labelled_scores(t), a, top=3)["top_features"])
