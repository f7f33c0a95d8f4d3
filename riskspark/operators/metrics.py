"""Model quality from given scores: curves, AUC, confusion, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.quantiles import value_bucket

# The reported thresholds.
THRESHOLDS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def threshold_metrics(scores: DataFrame, score: str = "score", label: str = "label",
                      thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall and F1 at each threshold, from one aggregate over the rows."""
    positive = F.col(label) == 1
    aggs = [F.count_if(positive).alias("p")]
    for i, t in enumerate(thresholds):
        flagged = F.col(score) >= F.lit(float(t))
        aggs += [F.count_if(flagged & positive).alias(f"tp{i}"), F.count_if(flagged).alias(f"f{i}")]
    one = scores.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"f{i}").alias("flagged")) for i, t in enumerate(thresholds)])
    flat = one.select("p", F.explode(rows).alias("r")).select("p", "r.*")
    precision, recall = _ratio(F.col("tp"), F.col("flagged")), _ratio(F.col("tp"), F.col("p"))
    return flat.select("threshold", precision.alias("precision"), recall.alias("recall"),
                       _ratio(2 * precision * recall, precision + recall).alias("f1"))


def curve_points(scores: DataFrame, score: str = "score", label: str = "label",
                 by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall point at every distinct score (of each group), highest first.

    Running counts are taken inside narrow value slices and the slice totals are
    added, so no task sees all distinct scores.
    """
    counts = (scores.groupBy(*by, F.col(score).cast("double").alias("threshold"))
              .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
              .withColumn("__slice", value_bucket(F.col("threshold"))))
    inside = (Window.partitionBy(*by, "__slice").orderBy(F.desc("threshold"))
              .rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*by)
    above = whole.orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices_df = counts.groupBy(*by, "__slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn")).select(
        *by, "__slice", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("bp"),
        F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("bn"),
        F.sum("sp").over(whole).alias("all_pos"), F.sum("sn").over(whole).alias("all_neg"))
    cum = counts.select("*", F.sum("pos").over(inside).alias("lp"), F.sum("neg").over(inside).alias("ln")) \
        .join(slices_df, [*by, "__slice"])
    tp, fp = F.col("lp") + F.col("bp"), F.col("ln") + F.col("bn")
    return cum.select(*by, "threshold", tp.alias("tp"), fp.alias("fp"), "pos", "neg", "all_pos", "all_neg",
                      _ratio(tp, F.col("all_pos")).alias("tpr"), _ratio(fp, F.col("all_neg")).alias("fpr"),
                      _ratio(tp, tp + fp).alias("precision"))


def auc(scores: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve (ties count half) and the class counts, per group if asked."""
    points = curve_points(scores, score, label, by)
    # A negative is beaten by the positives above its score and half of those at it.
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    pairs = F.first("all_pos") * F.first("all_neg")
    return points.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"),
                      F.first("all_pos").alias("positives"), F.first("all_neg").alias("negatives"))


def confusion(scores: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return scores.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_report(scores: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion counts."""
    cells = confusion(scores, prediction, label)
    parts = F.array(
        F.struct(F.col(label).alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("predicted")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("predicted")))
    flat = cells.select("n", (F.col(label) == F.col(prediction)).alias("hit"), F.explode(parts).alias("c"))
    sums = flat.groupBy("c.class").agg(
        F.sum(F.col("n") * F.col("c.actual")).alias("support"),
        F.sum(F.col("n") * F.col("c.predicted")).alias("flagged"),
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("c.actual")).otherwise(0)).alias("hits"))
    precision, recall = _ratio(F.col("hits"), F.col("flagged")), _ratio(F.col("hits"), F.col("support"))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"),
                       _ratio(2 * precision * recall, precision + recall).alias("f1"), "support")
