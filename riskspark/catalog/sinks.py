"""Round trips through the sinks: what was written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalog.base import query, rounded
from riskspark.catalog.decisions import FINAL, decisions
from riskspark.catalog.explain import FEATURES, LINEAR, WEIGHTS, Fitted
from riskspark.catalog.features import TXN_WINDOWS
from riskspark.catalog.streams import scratch
from riskspark.functions.times import WINDOW_HOURS
from riskspark.operators import behavior, decide, explain, models, registry
from riskspark.sources import tables
from riskspark.sources.driver import AS_OF


@query("csv_round_trip", "SELECT transaction_id, customer_id, amount, timestamp, channel FROM tx", "tx")
def csv_round_trip(t):
    place = scratch(t, "csv")
    rows = t.transactions().select("transaction_id", "customer_id", "amount", F.col("timestamp").cast("string").alias("timestamp"), "channel")
    tables.write_csv(rows, place)
    back = tables.read_csv(t.spark, place, "transaction_id long, customer_id long, amount double, timestamp string, channel string", ["timestamp"])
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("table_append_replace", """
SELECT product_type, count(*) * 2 AS n FROM tx WHERE status = 'approved' GROUP BY 1""", "tx")
def table_append_replace(t):
    """Replace, then append twice the same rows; partitions follow the product."""
    place = scratch(t, "table")
    rows = t.transactions().where("status = 'approved'").select("transaction_id", "product_type")
    tables.write_table(rows.where("transaction_id < 0"), place, "fail", partition_by=["product_type"])
    tables.write_table(rows, place, "replace", partition_by=["product_type"])
    tables.write_table(rows, place, "append", partition_by=["product_type"])
    return tables.read_table(t.spark, place, "parquet").groupBy("product_type").agg(F.count(F.lit(1)).alias("n"))


@query("prediction_log_append", "SELECT risk_level, count(*) * 2 AS n FROM (SELECT CASE WHEN f >= 0.8::DOUBLE THEN 'high' WHEN f >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level FROM ("
       + FINAL + ")) GROUP BY 1", "sc")
def prediction_log_append(t):
    """The log is appended to by date; two runs leave two entries per transaction."""
    place = scratch(t, "log")
    d = decide.decide(t.transactions().select("transaction_id", "customer_id", "product_type").join(t.scored(), "transaction_id"),
                      with_explanation=False)
    log = decide.prediction_log(d, {"hub_model": "1"}, AS_OF).withColumn("date", F.to_date("timestamp"))
    for _ in range(2):
        tables.write_table(log, place, "append", partition_by=["date"])
    return tables.read_table(t.spark, place, "parquet").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query("feature_table_round_trip", TXN_WINDOWS, "tx")
def feature_table_round_trip(t):
    """Wide features stored in long form by date and turned wide again."""
    place = scratch(t, "features")
    wide = behavior.transaction_windows(t.transactions(), AS_OF)
    tables.write_table(registry.to_long(wide).withColumn("as_of", F.lit(AS_OF[:10])), place, "replace", partition_by=["as_of"])
    names = [c for c in wide.columns if c != "customer_id"]
    back = registry.to_wide(tables.read_table(t.spark, place, "parquet"), names)
    counts = [f"transaction_count_{w}" for w in WINDOW_HOURS]
    return rounded(back.select("customer_id", *[F.col(c).cast("bigint").alias(c) if c in counts else F.col(c) for c in names]))


@query("explanations_round_trip", f"SELECT customer_id, feature, round(value, 4) AS value, round(attribution, 4) AS attribution FROM ({LINEAR})", "demo")
def explanations_round_trip(t):
    """Explanation rows saved as JSON documents and read with their schema."""
    place = scratch(t, "explanations")
    rows = explain.linear_attributions(t.demo_profiles(), "customer_id", WEIGHTS)
    explain.save_explanations(rows, place)
    return rounded(explain.load_explanations(t.spark, place, rows.schema))


@query("model_save_load")
def model_save_load(t):
    """A stored pipeline gives the scores it gave before."""
    f = Fitted.of(t)
    place = scratch(t, "model")
    models.save(f.trained, place, "1", t.spark)
    again = models.load(t.spark, place)
    rows = t.demo_profiles().select("customer_id", *FEATURES)
    both = f.trained.score(rows, "before").select("customer_id", "before").join(
        again.score(rows, "after").select("customer_id", "after"), "customer_id")
    return rounded(both)


@query("decision_json_summary", "SELECT '{\"decisions\":' || count(*) || '}' AS summary FROM tx", "tx")
def decision_json_summary(t):
    place = scratch(t, "summary")
    tables.json_summary(decisions(t), {"decisions": F.count(F.lit(1))}).write.text(place)
    return t.spark.read.text(place).withColumnRenamed("value", "summary")
