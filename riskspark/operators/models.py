"""Models: a customer-level hub and per-product spokes on MLlib."""

from __future__ import annotations

import itertools
import json
import logging
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import metrics, modeling_table, point_in_time, training
from riskspark.plans.fixpoint import cut, held, side_by_side

log = logging.getLogger(__name__)

# Hidden layers of the loan network and the score without a model.
LOAN_LAYERS = (128, 64, 32)
DEFAULT_SCORE = 0.5


@dataclass(frozen=True)
class Spec:
    """Which learner to fit and its parameters; ``gbt``, ``forest``, ``logistic`` or ``mlp``."""
    name: str
    algorithm: str = "gbt"
    params: Mapping[str, object] = field(default_factory=dict)
    seed: int = 42


@dataclass
class Trained:
    spec: Spec
    features: list[str]
    model: Model
    metrics: dict[str, float]

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Probability of the positive class for every row; missing features count as 0."""
        drop = ("raw", "features", "rawPrediction", "probability", "prediction")
        filled = df.fillna(0, [c for c in self.features if c in df.columns])
        scored = self.model.transform(filled)
        return scored.withColumn(out, vector_to_array("probability")[1]).drop(*drop)


def learner(spec: Spec, width: int):
    common = {"featuresCol": "features", "labelCol": "label"}
    p = dict(spec.params)
    if spec.algorithm == "gbt":
        base = {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8,
                "validationIndicatorCol": "is_validation", "validationTol": 0.001}
        return GBTClassifier(**common, seed=spec.seed, **{**base, **p})
    if spec.algorithm == "forest":
        base = {"numTrees": 40, "maxDepth": 6, "subsamplingRate": 0.8}
        return RandomForestClassifier(**common, seed=spec.seed, **{**base, **p})
    if spec.algorithm == "logistic":
        return LogisticRegression(**common, **{"maxIter": 50, "regParam": 0.01, **p})
    if spec.algorithm == "mlp":
        layers = [width, *p.pop("hidden", LOAN_LAYERS), 2]
        return MultilayerPerceptronClassifier(**common, layers=layers, seed=spec.seed, **{"maxIter": 60, "tol": 1e-4, **p})
    raise ValueError(f"unknown algorithm {spec.algorithm!r}")


def fit(rows: DataFrame, features: Sequence[str], spec: Spec) -> Model:
    """Fit on rows with ``label`` and ``part``; scaling is learned on training rows only."""
    features = list(features)
    assembler = VectorAssembler(inputCols=features, outputCol="raw")
    raw = assembler.transform(rows.withColumn("is_validation", F.col("part") == "validation"))
    train = raw.where("part = 'train'")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
    estimator = learner(spec, len(features))
    source = raw.where("part <> 'test'") if spec.algorithm == "gbt" else train
    classifier = estimator.fit(scaler.transform(source))
    return PipelineModel(stages=[assembler, scaler, classifier])


def train_model(rows: DataFrame, features: Sequence[str], spec: Spec) -> Trained:
    """Train and measure; ``rows`` carries ``label`` (0/1), ``part`` and the features."""
    out = Trained(spec, list(features), None, {})
    columns = [F.col("label").cast("double").alias("label"), "part", *dict.fromkeys(features)]
    with held(rows.fillna(0).select(*columns)) as rows:
        out.model = fit(rows, features, spec)
        scored = out.score(rows).select("part", "label", "score")
        # One row per part.
        found = {r["part"]: r for r in metrics.auc(scored, by=["part"]).collect()}
    for part in ("train", "validation", "test"):
        out.metrics[f"{part}_auc"] = found[part]["auc"] if part in found else None
    out.metrics["feature_count"] = len(out.features)
    train = found.get("train")
    out.metrics["training_samples"] = train["positives"] + train["negatives"] if train else 0
    return out


def importances(spark: SparkSession, trained: Trained) -> DataFrame:
    """Named feature importances, largest first (absolute weights for a linear model)."""
    last = trained.model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = [(n, float(v)) for n, v in zip(trained.features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(trained: Trained, path: str, version: str, spark: SparkSession) -> None:
    """Pipeline and a JSON row of metadata under one path of a shared file system."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    meta = {"name": trained.spec.name, "algorithm": trained.spec.algorithm, "params": dict(trained.spec.params),
            "features": trained.features, "metrics": trained.metrics, "version": version}
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Trained:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    spec = Spec(meta["name"], meta["algorithm"], meta["params"])
    return Trained(spec, meta["features"], PipelineModel.load(f"{path}/pipeline"), meta["metrics"])


def grid_specs(base: Spec, choices: Mapping[str, Sequence]) -> list[Spec]:
    """Every combination of a parameter grid."""
    return [Spec(f"{base.name}_{i}", base.algorithm, {**base.params, **dict(zip(choices, picked))})
            for i, picked in enumerate(itertools.product(*choices.values()))]


def _fold_auc(blocks: DataFrame, features: Sequence[str], spec: Spec, id_column: str, fold: int) -> float | None:
    """AUC on block ``fold + 1`` of a model that has seen the blocks up to ``fold``."""
    # The learner may watch some of the training rows; the test block is never fitted.
    part = F.when(F.col("block") == fold + 1, "test").when(training.stable_fraction(id_column) < 0.1, "validation").otherwise("train")
    marked = blocks.where(F.col("block") <= fold + 1).withColumn("part", part)
    one = Trained(spec, list(features), fit(marked, features, spec), {})
    found = metrics.auc(one.score(marked.where("part = 'test'"))).first()
    return found["auc"] if found else None


def search(rows: DataFrame, features: Sequence[str], specs: Sequence[Spec], ts: str, id_column: str,
           folds: int = 3, keep: float = 1.0, together: int = 8) -> DataFrame:
    """(name, params, folds, mean_auc) of each candidate over forward-chaining folds, best first.

    After each fold the best ``keep`` of the candidates go on to the next, longer one (all of them by
    default); those that got further rank first. ``together`` candidates train side by side on one
    stored table that holds their inputs alone.
    """
    columns = list(dict.fromkeys([id_column, ts, *features]))
    blocks = training.time_folds(rows.fillna(0).select(*columns, F.col("label").cast("double").alias("label")), ts, id_column, folds)
    left, scores = list(specs), {s.name: [] for s in specs}

    def mean(name: str) -> float:
        known = [x for x in scores[name] if x is not None]
        return sum(known) / len(known) if known else -1.0

    with held(blocks.drop(ts), "block") as blocks, ThreadPoolExecutor(max_workers=together) as pool:
        for fold in range(folds):
            one = inheritable_thread_target(rows.sparkSession)(lambda s: _fold_auc(blocks, features, s, id_column, fold))  # noqa: B023
            for spec, auc in zip(left, pool.map(one, left)):
                scores[spec.name].append(auc)
            left = sorted(left, key=lambda s: (-mean(s.name), s.name))[:max(1, math.ceil(keep * len(left)))]
    results = [(s.name, json.dumps(dict(s.params)), len(scores[s.name]), None if mean(s.name) < 0 else mean(s.name)) for s in specs]
    return rows.sparkSession.createDataFrame(results, "name string, params string, folds int, mean_auc double").orderBy(
        F.desc("folds"), F.desc_nulls_last("mean_auc"), "name")


# --- hub --------------------------------------------------------------------------------

HUB_SPECS = {"gbt": Spec("hub", "gbt"), "forest": Spec("hub", "forest")}


def hub_inputs(training_set: DataFrame) -> tuple[DataFrame, list[str]]:
    """The hub's training rows with an id and derived columns, and the names of its features."""
    rows = modeling_table.derived_inputs(training_set.withColumn(
        "row_id", F.concat_ws(":", "customer_id", F.col("label_timestamp").cast("string"), "is_fraud")))
    skip = {"customer_id", "is_fraud", "label_timestamp", "row_id"}
    features = [f.name for f in rows.schema.fields if f.name not in skip]
    for name in features:
        if dict(rows.dtypes)[name] == "boolean":
            rows = rows.withColumn(name, F.col(name).cast("int"))
    return rows, features


def train_hub(training_set: DataFrame, spec: Spec | str = "gbt") -> Trained:
    """Customer-level model from the labelled point-in-time set."""
    spec = HUB_SPECS[spec] if isinstance(spec, str) else spec
    rows, features = hub_inputs(training_set)
    parts = training.split_by_time(rows, "label_timestamp", "row_id")
    return train_model(parts.withColumnRenamed("is_fraud", "label"), features, spec)


def hub_scores(hub: Trained, vectors: DataFrame) -> DataFrame:
    """Risk score of every customer."""
    ready = modeling_table.derived_inputs(vectors)
    for name, kind in ready.dtypes:
        if kind == "boolean":
            ready = ready.withColumn(name, F.col(name).cast("int"))
    return hub.score(ready, "hub_score").select("customer_id", "hub_score")


# --- spokes -----------------------------------------------------------------------------

Builder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Spoke:
    """A product's model: which columns it reads, how to add them, and the learner.

    ``build`` gets enriched transactions (``batch.enrich``) and only projects, so
    scoring a product adds no shuffle.
    """
    product: str
    features: tuple[str, ...]
    build: Builder
    spec: Spec
    needs_hub: bool = True

    def inputs(self) -> list[str]:
        return [*self.features, *(["hub_score"] if self.needs_hub else [])]


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


# The inputs of each product's model.
SPOKES: dict[str, Spoke] = {
    "pix": Spoke("pix", ("transaction_amount", "is_round_amount", "is_weekend", "hour_of_day", "is_night_transaction",
                         "minutes_since_last_transaction", "distance_from_usual_location_km", "amount_zscore",
                         "is_new_beneficiary"), _as_is, Spec("pix_fraud_model", "gbt")),
    "credit_card": Spoke("credit_card", ("transaction_amount", "merchant_category_encoded", "is_online_transaction",
                                         "distance_from_usual_location_km", "amount_zscore", "merchant_risk_score",
                                         "card_present"), modeling_table.with_card_rules, Spec("credit_card_fraud_model", "gbt")),
    "loan": Spoke("loan", ("loan_amount", "loan_purpose_encoded", "debt_to_income_ratio", "employment_stability_score",
                           "collateral_value_ratio", "interest_rate"), modeling_table.with_loan_rules, Spec("loan_fraud_model", "mlp")),
}


def labelled_context(transactions: DataFrame, labels: DataFrame, as_of, product: str | None = None) -> DataFrame:
    """Labelled transactions (of one product if given) with their context as of their own time."""
    kept = training.labelled_transactions(transactions, labels, as_of, product)
    return training.with_new_beneficiary(point_in_time.context_before(kept, transactions), transactions)


def product_training_set(spoke: Spoke, rows: DataFrame, hub_at_label: DataFrame | None = None) -> DataFrame:
    """The product's part of the labelled rows with its features.

    ``hub_at_label`` (customer_id, label_timestamp, hub_score) has the customer's score as it was just before
    the label; without it the set has no such column.
    """
    rows = rows.where(F.col("product_type") == spoke.product)
    if hub_at_label is not None:
        rows = rows.join(hub_at_label, ["customer_id", "label_timestamp"], "left").fillna(DEFAULT_SCORE, ["hub_score"])
    columns = spoke.inputs() if hub_at_label is not None else spoke.features
    return spoke.build(rows).select("transaction_id", "customer_id", "timestamp", "is_fraud", *columns).fillna(0)


def hub_at_labels(hub: Trained, hub_rows: DataFrame) -> DataFrame:
    """(customer_id, label_timestamp, hub_score) from the hub's training rows, which end just before each label."""
    scored = hub.score(modeling_table.derived_inputs(hub_rows), "hub_score")
    return scored.groupBy("customer_id", "label_timestamp").agg(F.avg("hub_score").alias("hub_score"))


def train_spokes(rows: DataFrame, hub_at_label: DataFrame, spokes: Mapping[str, Spoke] = SPOKES,
                 only: Sequence[str] | None = None) -> tuple[dict[str, Trained], dict[str, str]]:
    """Train all or some products on the labelled rows; a failure of one is reported and does not stop the others."""
    def one(name: str) -> Trained | Exception:
        spoke = spokes[name]
        try:
            parts = training.split_by_time(cut(product_training_set(spoke, rows, hub_at_label)), "timestamp", "transaction_id")
            return train_model(parts.withColumnRenamed("is_fraud", "label"), spoke.inputs(), spoke.spec)
        except Exception as error:
            log.exception("training %s failed", name)
            return error

    names = list(only or spokes)
    found = dict(zip(names, side_by_side(rows.sparkSession, one, names)))
    failed = {name: str(x) for name, x in found.items() if isinstance(x, Exception)}
    return {name: x for name, x in found.items() if name not in failed}, failed


def metrics_table(spark: SparkSession, trained: Mapping[str, Trained]) -> DataFrame:
    rows = [(name, metric, None if value is None else float(value)) for name, t in trained.items()
            for metric, value in t.metrics.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def spoke_scores(trained: Mapping[str, Trained], enriched: DataFrame, spokes: Mapping[str, Spoke] = SPOKES) -> DataFrame:
    """Enriched transactions with ``spoke_score`` from their product's model; 0.5 where there is none.

    Products are narrow branches of one table, united again: no join back.
    """
    columns = enriched.columns
    covered = F.coalesce(F.col("product_type").isin(*trained), F.lit(False)) if trained else F.lit(False)
    out = enriched.where(~covered).withColumn("spoke_score", F.lit(DEFAULT_SCORE))
    for name, model in trained.items():
        rows = spokes[name].build(enriched.where(F.col("product_type") == name))
        out = out.unionByName(model.score(rows, "spoke_score").select(*columns, "spoke_score"))
    return out
