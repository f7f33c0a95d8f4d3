"""Training-set, model and batch-decision queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from riskspark.catalog.base import ASOF_SQL, query, rounded
from riskspark.catalog.features import inputs
from riskspark.functions.times import WINDOW_HOURS
from riskspark.operators import batch, behavior, modeling_table, models, network, registry, training
from riskspark.plans.fixpoint import cut, settled
from riskspark.sources.driver import AS_OF

CONFIDENT = f"SELECT * FROM fl WHERE confidence_score >= 0.8::DOUBLE AND label_timestamp >= {ASOF_SQL} - INTERVAL 730 DAY"


@query("labelled_transactions", f"""
SELECT t.transaction_id, t.customer_id, round(amount, 4) AS amount, l.is_fraud, l.label_timestamp
FROM tx t JOIN ({CONFIDENT}) l USING (transaction_id) WHERE product_type = 'pix'""", "tx fl")
def labelled_transactions(t):
    rows = training.labelled_transactions(t.transactions(), t.fraud_labels(), AS_OF, "pix")
    return rounded(rows.select("transaction_id", "customer_id", "amount", "is_fraud", "label_timestamp"))


NEW_BENEFICIARY = """
WITH f AS (SELECT customer_id, beneficiary_id, min(timestamp) AS a FROM tx WHERE product_type = 'pix' AND beneficiary_id IS NOT NULL GROUP BY 1, 2)
SELECT transaction_id, CASE WHEN a < timestamp THEN 0 ELSE 1 END AS is_new_beneficiary
FROM tx LEFT JOIN f USING (customer_id, beneficiary_id)"""


@query("new_beneficiary", NEW_BENEFICIARY, "tx")
def new_beneficiary(t):
    return training.new_beneficiary(t.transactions(), t.transactions())


def _pit() -> str:
    cols = []
    for w, h in WINDOW_HOURS.items():
        c = f"FILTER (WHERE t.timestamp >= label_timestamp - INTERVAL {h} HOUR)"
        cols += [f"count(t.amount) {c} AS transaction_count_{w}",
                 f"round(coalesce(sum(t.amount) {c}, 0), 4) AS transaction_volume_{w}",
                 f"round(coalesce(avg(t.amount) {c}, 0), 4) AS avg_transaction_amount_{w}"]
    return f"""
SELECT l.customer_id, l.is_fraud, l.label_timestamp, {', '.join(cols)}
FROM (SELECT DISTINCT customer_id, is_fraud, label_timestamp FROM ({CONFIDENT})) l
LEFT JOIN (SELECT * FROM tx WHERE status = 'approved') t ON t.customer_id = l.customer_id AND t.timestamp <= label_timestamp GROUP BY 1, 2, 3"""


@query("point_in_time_windows", _pit(), "tx fl")
def point_in_time_windows(t):
    """Window features as they were when each label was given."""
    labels = training.customer_labels(t.fraud_labels(), AS_OF)
    return rounded(training.point_in_time_windows(labels, t.transactions()))


@query("time_ordered_split", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY timestamp, transaction_id) AS pos, count(*) OVER () AS n FROM tx)
SELECT transaction_id, CASE WHEN pos > floor(n * (1 - 0.1::DOUBLE)) THEN 'test'
  WHEN CAST('0x' || substr(md5('42:' || transaction_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'validation' ELSE 'train' END AS part FROM r""", "tx")
def time_ordered_split(t):
    return training.split_by_time(t.transactions(), "timestamp", "transaction_id").select("transaction_id", "part")


@query("time_folds", """
SELECT transaction_id, CAST(least(floor((row_number() OVER (ORDER BY timestamp, transaction_id) - 1) * 4 / count(*) OVER ()), 3) AS INTEGER) AS block FROM tx""", "tx")
def time_folds(t):
    return training.time_folds(t.transactions(), "timestamp", "transaction_id").select("transaction_id", "block")


@query("derived_inputs", f"""
WITH v AS (SELECT customer_id, count(*) FILTER (WHERE timestamp >= {ASOF_SQL} - INTERVAL 1 HOUR) AS c1,
  count(*) FILTER (WHERE timestamp >= {ASOF_SQL} - INTERVAL 24 HOUR) AS c24,
  coalesce(sum(amount) FILTER (WHERE timestamp >= {ASOF_SQL} - INTERVAL 24 HOUR), 0) AS v24 FROM tx
  WHERE status = 'approved' AND timestamp <= {ASOF_SQL} AND timestamp >= {ASOF_SQL} - INTERVAL 2160 HOUR GROUP BY 1)
SELECT customer_id, round(v24 / (c24 + 1), 4) AS avg_transaction_size_24h, round(c1 / (c24 / 24 + 0.1::DOUBLE), 4) AS velocity_ratio_1h_24h FROM v""", "tx")
def derived_inputs(t):
    wide = modeling_table.derived_inputs(behavior.transaction_windows(t.transactions(), AS_OF))
    return rounded(wide.select("customer_id", "avg_transaction_size_24h", "velocity_ratio_1h_24h"))


class Stage:
    """Trained models and shared intermediate tables of one data folder in one application.

    Each part is built when it is first asked for; ``with_parts`` builds parts that don't need each other side by side.
    """

    _known: dict[tuple[str, str], "Stage"] = {}

    def __init__(self, t):
        self.t = t

    @classmethod
    def of(cls, t) -> "Stage":
        key = (t.spark.sparkContext.applicationId, t.folder)
        if key not in cls._known:
            cls._known[key] = cls(t)
        return cls._known[key]

    def with_parts(self, *names: str) -> "Stage":
        models.side_by_side(self.t.spark, lambda name: getattr(self, name), names)
        return self

    def ready(self) -> "Stage":
        """Everything, in three steps of independent parts."""
        return self.with_parts("hub", "labelled", "net").with_parts("hub_scores", "at_label").with_parts("enriched", "spokes")

    @cached_property
    def net(self):
        return settled(self.t.spark, lambda: network.network_features(self.t.transactions(), self.t.fraud_records(), AS_OF))

    @cached_property
    def hub_rows(self):
        return settled(self.t.spark, lambda: training.hub_training_set(self.t.fraud_labels(), inputs(self.t), AS_OF))

    @cached_property
    def hub(self):
        return models.train_hub(self.hub_rows, models.Spec("hub", "gbt"))

    @cached_property
    def hub_scores(self):
        vectors = registry.default_registry().feature_vector(inputs(self.t)).withColumn("is_pep", F.col("is_pep").cast("int")).fillna(0)
        return cut(models.hub_scores(self.hub, vectors))

    @cached_property
    def enriched(self):
        tx = self.t.transactions()
        return settled(self.t.spark, lambda: batch.enrich(tx, tx, self.hub_scores, AS_OF), "product_type")

    @cached_property
    def at_label(self):
        return cut(models.hub_at_labels(self.hub, self.hub_rows))

    @cached_property
    def labelled(self):
        return settled(self.t.spark, lambda: models.labelled_context(self.t.transactions(), self.t.fraud_labels(), AS_OF), "product_type")

    @cached_property
    def spokes(self):
        spokes, failed = models.train_spokes(self.labelled, self.at_label)
        if failed:
            raise RuntimeError(f"training failed: {failed}")
        return spokes

    def scorer(self, t) -> batch.Scorer:
        self.with_parts("hub", "labelled", "net").with_parts("hub_scores", "at_label")
        return batch.Scorer(self.spokes, self.hub_scores, t.transactions(), self.net, AS_OF)


@query("hub_scores")
def hub_scores(t):
    """Risk score of every customer by the boosted hub model."""
    return rounded(Stage.of(t).hub_scores)


@query("hub_importances")
def hub_importances(t):
    return models.importances(t.spark, Stage.of(t).hub)


@query("model_metrics")
def model_metrics(t):
    """AUC per part, feature and row counts of the hub and every product model."""
    s = Stage.of(t).with_parts("hub", "labelled")
    return models.metrics_table(t.spark, {"hub": s.hub, **s.spokes})


@query("spoke_scores")
def spoke_scores(t):
    """Every transaction scored by its product's model."""
    s = Stage.of(t).with_parts("hub", "labelled").with_parts("hub_scores", "at_label").with_parts("enriched", "spokes")
    return rounded(models.spoke_scores(s.spokes, s.enriched).select("transaction_id", "spoke_score"))


@query("hub_score_per_transaction")
def hub_score_per_transaction(t):
    rows = training.attach_hub_score(t.transactions().select("transaction_id", "customer_id"), Stage.of(t).hub_scores)
    return rounded(rows)


@query("forest_hub_metrics")
def forest_hub_metrics(t):
    """The second hub learner."""
    forest = models.train_hub(Stage.of(t).hub_rows, models.Spec("hub", "forest"))
    return models.metrics_table(t.spark, {"forest": forest})


# The grids searched for boosted trees and for the dense network.
TREE_GRID = {"stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 4, 5]}
LAYER_GRID = {"hidden": [(32,), (64, 32), (128, 64, 32)], "maxIter": [30, 60, 120]}


@query("parameter_search")
def parameter_search(t):
    """The whole grid of the hub and of every product, by successive halving over forward-chaining folds."""
    s = Stage.of(t).with_parts("hub", "labelled")
    hub_rows, hub_features = models.hub_inputs(s.hub_rows)
    jobs = [("hub", hub_rows, hub_features, models.Spec("hub", "gbt"), "label_timestamp", "row_id")]
    for name, spoke in models.SPOKES.items():
        jobs.append((name, models.product_training_set(spoke, s.labelled, s.at_label), spoke.inputs(), spoke.spec, "timestamp", "transaction_id"))

    def ranked(job):
        name, rows, features, spec, ts, key = job
        specs = models.grid_specs(spec, LAYER_GRID if spec.algorithm == "mlp" else TREE_GRID)
        return models.search(rows.withColumnRenamed("is_fraud", "label"), features, specs, ts, key, keep=1 / 3).withColumn("model", F.lit(name))

    out = None
    for found in models.side_by_side(t.spark, ranked, jobs):
        out = found if out is None else out.unionByName(found)
    return out


@query("batch_decisions")
def batch_decisions(t):
    """Validation, context, hub, spokes and decision for all transactions."""
    s = Stage.of(t)
    d = batch.decide_batch(t.transactions(), s.scorer(t))
    return rounded(d.select("transaction_id", "hub_risk_score", "spoke_fraud_score", "final_score", "risk_level",
                            "action", F.concat_ws(",", "reason_codes").alias("reasons"), "confidence"))
