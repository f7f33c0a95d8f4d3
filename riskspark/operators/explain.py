"""Explanations over many rows: attributions, counterfactuals, local surrogates, texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators import metrics
from riskspark.operators.modeling_table import stable_sample
from riskspark.plans.fixpoint import cut

# Background size, strength and level limits.
BACKGROUND = 100
STRONG, MODERATE = 0.1, 0.05
TEXT_LEVELS = ((0.5, "HIGH"), (0.2, "MEDIUM"))
SUMMARY_LEVELS = ((0.7, "HIGH"), (0.3, "MEDIUM"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments, so retries give the same value."""
    return F.pmod(F.xxhash64(*parts), F.lit(2 ** 40)) / F.lit(float(2 ** 40))


def feature_array(df: DataFrame, features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def dealt_out(df: DataFrame, id_column: str) -> DataFrame:
    """The rows over several tasks per core, before each of them becomes hundreds: a table of a few megabytes is
    read by one task, and it is small only until then. Named, so that adaptive execution does not join them again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, id_column)


def background(df: DataFrame, id_column: str, features: Sequence[str], n: int = BACKGROUND) -> DataFrame:
    """At most ``n`` reference rows as arrays: a bounded table by construction."""
    return stable_sample(df.select(id_column, *features), id_column, n).select(
        F.col(id_column).alias("b_id"), feature_array(df, features).alias("b"))


def class_one(model: Model, df: DataFrame, vector: Column) -> DataFrame:
    """Column ``f``: probability of class 1 for a raw feature array; one ``transform``.

    ``model`` is a fitted pipeline whose first stage assembles ``raw``; later stages run as they are.
    """
    staged = df.withColumn("raw", array_to_vector(vector))
    for stage in model.stages[1:]:
        staged = stage.transform(staged)
    return staged.withColumn("f", vector_to_array("probability")[1]).drop(
        "raw", "features", "rawPrediction", "probability", "prediction")


def linear_attributions(df: DataFrame, id_column: str, weights: Mapping[str, float],
                        reference: DataFrame | None = None) -> DataFrame:
    """Exact attributions of a linear model: weight times distance from the mean, long form."""
    source = reference if reference is not None else df
    means = source.agg(F.create_map(*[x for f in weights for x in (F.lit(f), F.avg(F.col(f).cast("double")))]).alias("m")).scalar()
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                              (F.lit(float(w)) * (F.col(f).cast("double") - means[f])).alias("attribution"))
                     for f, w in weights.items()])
    return df.select(id_column, F.explode(rows).alias("r")).select(id_column, "r.*")


def sampled_attributions(model: Model, df: DataFrame, id_column: str, features: Sequence[str],
                         reference: DataFrame) -> DataFrame:
    """Sampled Shapley values of any classifier, long form (feature, value, attribution, base).

    For each background row a seeded order switches the features one by one
    from background to row; all switched points are scored in one transform.
    The attributions of a row add up to its score minus the mean background score.
    """
    d = len(features)
    pool = reference.agg(F.collect_list(F.struct("b_id", "b")).alias("pool")).scalar()
    pairs = dealt_out(df, id_column).select(F.col(id_column).alias("id"), feature_array(df, features).alias("x"), F.explode(pool).alias("p")) \
        .select("id", "x", F.col("p.b_id").alias("b_id"), F.col("p.b").alias("b"))
    keyed = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(
        F.xxhash64("id", "b_id", i).alias("h"), i.alias("i")))
    ordered = pairs.withColumn("order", F.transform(F.array_sort(keyed), lambda s: s["i"]))
    # A column per feature, so that the switched points are made by compiled code and places are found once a pair.
    placed = ordered.select("*", *[F.array_position("order", F.lit(i)).alias(f"at{i}") for i in range(d)])
    steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    point = F.array(*[F.when(F.col(f"at{i}") <= F.col("step"), F.get("x", F.lit(i))).otherwise(F.get("b", F.lit(i))) for i in range(d)])
    scored = class_one(model, steps.select("id", "x", "order", "step", point.alias("z")), F.col("z"))
    # A score enters the feature just switched on with plus and the next one with minus.
    signs = F.array(F.struct(F.get("order", F.col("step") - 1).alias("i"), F.col("f").alias("v")),
                    F.struct(F.get("order", F.col("step")).alias("i"), (-F.col("f")).alias("v")))
    base = F.when(F.col("step") == 0, F.col("f"))
    flat = scored.select("id", "x", base.alias("base"), F.explode(signs).alias("s"))
    sums = flat.where("s.i IS NOT NULL").groupBy("id", F.col("s.i").alias("i")).agg(
        F.sum("s.v").alias("total"), F.any_value("x").alias("x"))
    bases = scored.where("step = 0").groupBy("id").agg(F.avg("f").alias("base"), F.count(F.lit(1)).alias("n"))
    names = F.array(*map(F.lit, features))
    return sums.join(bases, "id").select(
        F.col("id").alias(id_column), F.get(names, F.col("i")).alias("feature"), F.get("x", F.col("i")).alias("value"),
        (F.col("total") / F.col("n")).alias("attribution"), "base")


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean and mean absolute attribution per feature."""
    return attributions.groupBy("feature").agg(
        F.avg("attribution").alias("importance"), F.avg(F.abs("attribution")).alias("abs_importance"))


def _level(score: Column, levels) -> Column:
    out = F.lit("LOW")
    for limit, name in reversed(levels):
        out = F.when(score > limit, F.lit(name)).otherwise(out)
    return out


def explanation_texts(attributions: DataFrame, id_column: str, base: Column | None = None, top: int = 5) -> DataFrame:
    """Score, level and a sentence for each of the strongest factors of a row."""
    by_size = F.struct((-F.abs("attribution")).alias("k"), F.col("feature").alias("feature"),
                       F.col("value").alias("value"), F.col("attribution").alias("a"))
    start = base if base is not None else F.lit(0.0)
    rows = attributions.groupBy(id_column).agg(
        F.slice(F.array_sort(F.collect_list(by_size)), 1, top).alias("factors"),
        (F.sum("attribution") + F.max(start)).alias("score"))

    # The wording of the text, here and below.
    def sentence(x: Column, i: Column) -> Column:
        size = F.abs(x["a"])
        impact = F.when(size > STRONG, "strongly").when(size > MODERATE, "moderately").otherwise("slightly")
        direction = F.when(x["a"] > 0, "increases").otherwise("decreases")
        return F.format_string("%d. **%s** = %.3f %s %s fraud risk (impact: %+.3f)",
                               i + 1, x["feature"], x["value"], impact, direction, x["a"])

    level = _level(F.col("score"), TEXT_LEVELS)
    text = F.concat(F.format_string("**Risk Level: %s** (Score: %.3f)\n**Key Factors:**\n", level, F.col("score")),
                    F.array_join(F.transform("factors", sentence), "\n"))
    return rows.select(id_column, "score", level.alias("level"), F.col("factors.feature").alias("top_features"), text.alias("text"))


def feature_ranges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: lowest and highest observed value of each feature, as arrays."""
    return df.agg(F.array(*[F.min(F.col(f).cast("double")) for f in features]).alias("lo"),
                  F.array(*[F.max(F.col(f).cast("double")) for f in features]).alias("hi"))


def counterfactuals(model: Model, df: DataFrame, id_column: str, features: Sequence[str], reference: DataFrame,
                    wanted: int = 0, keep: int = 5, candidates: int = 40, share: float = 0.5,
                    seed: int = 42, steps: int = 5) -> DataFrame:
    """Changed versions of each row that reach the wanted class, nearest first.

    A seeded hash picks which features change and to what value inside the
    observed range. Distances are scaled by that range. Rows that have fewer than
    ``keep`` are tried again with other picks that change more features, until all
    are complete or a round reaches nothing new. Rows still open are then searched by
    every move of one or two features to ``steps`` values over the range, and on
    from the best point so far while it improves. ``reached`` tells how many a row
    got; a row that got none has one row with 0 and no rank.
    """
    from pyspark.sql import Window
    ranges = feature_ranges(reference, features)
    lo, hi = ranges.select("lo").scalar(), ranges.select("hi").scalar()
    rows = dealt_out(df, id_column).select(F.col(id_column).alias("id"), feature_array(df, features).alias("x"), lo.alias("lo"), hi.alias("hi"))

    def tried(open_rows: DataFrame, first: int, part: float) -> DataFrame:
        tries = open_rows.withColumn("candidate", F.explode(F.sequence(F.lit(first), F.lit(first + candidates - 1))))
        changed = F.transform("x", lambda v, i: F.when(
            uniform(F.lit(seed), F.col("id"), F.col("candidate"), i, F.lit("pick")) < part,
            F.get("lo", i) + uniform(F.lit(seed), F.col("id"), F.col("candidate"), i, F.lit("value"))
            * (F.get("hi", i) - F.get("lo", i))).otherwise(v))
        return judged(tries.withColumn("z", changed)).where("ok").drop("ok")

    def judged(tries: DataFrame) -> DataFrame:
        scored = class_one(model, tries, F.col("z"))
        gap = F.aggregate(F.transform("x", lambda v, i: F.when(
            F.get("hi", i) > F.get("lo", i), F.abs(v - F.get("z", i)) / (F.get("hi", i) - F.get("lo", i))).otherwise(0.0)),
            F.lit(0.0), lambda a, v: a + v)
        return scored.select("id", "candidate", gap.alias("distance"), "f", "x", "z",
                             (F.when(F.col("f") > 0.5, 1).otherwise(0) == wanted).alias("ok"))

    def moved(open_rows: DataFrame, first: int) -> DataFrame:
        """Every move of features i <= j from the point ``at`` to p and q of the ``steps`` values."""
        d = len(features)
        tries = open_rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(d * d * steps * steps - 1))))
        tries = tries.withColumns({"i": F.expr(f"c div {d * steps * steps}"), "j": F.expr(f"c div {steps * steps} % {d}"),
                                   "p": F.expr(f"c div {steps} % {steps}"), "q": F.expr(f"c % {steps}")})
        tries = tries.where("i < j or i = j and p = q").withColumn("candidate", F.col("c") + first)
        value = lambda k, n: F.get("lo", k) + F.col(n) * (F.get("hi", k) - F.get("lo", k)) / (steps - 1)
        z = F.transform("at", lambda v, k: F.when(k == F.col("i"), value(k, "p")).when(k == F.col("j"), value(k, "q")).otherwise(v))
        return judged(tries.withColumn("z", z))

    found, first, part = cut(tried(rows, 1, share)), 1, share
    while True:
        counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("reached"))
        open_rows = rows.join(counts.where(F.col("reached") >= keep).select("id"), "id", "left_anti")
        first, part = first + candidates, 1 - (1 - part) / 2
        more = cut(tried(open_rows, first, part))
        if more.isEmpty():
            break
        found = cut(found.unionByName(more))
    toward = F.col("f") if wanted == 0 else -F.col("f")
    first, open_rows = first + candidates, cut(open_rows.withColumns({"at": F.col("x"), "least": F.lit(float("inf"))}))
    while not open_rows.isEmpty():
        scored = cut(moved(open_rows, first))
        found = cut(found.unionByName(scored.where("ok").drop("ok").dropDuplicates(["id", "z"])))
        best = scored.groupBy("id").agg(F.min_by("z", F.struct(toward, "candidate")).alias("at"), F.min(toward).alias("new"), F.max("ok").alias("any"))
        first += (len(features) * steps) ** 2
        open_rows = cut(open_rows.drop("at").join(best, "id").where("not any and new < least - 1e-12").select(
            "id", "x", "lo", "hi", "at", F.col("new").alias("least")))
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("reached"))
    near = Window.partitionBy("id").orderBy("distance", "candidate")  # some rounds of ``candidates`` rows per id
    ranked = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= keep)
    return rows.select("id", "x").join(ranked.drop("x"), "id", "left").join(counts, "id", "left").select(
        F.col("id").alias(id_column), "rank", "distance", F.col("f").alias("score"), "x", "z",
        F.least(F.coalesce("reached", F.lit(0)), F.lit(keep)).alias("reached"))


def long_changes(found: DataFrame, id_column: str, features: Sequence[str]) -> DataFrame:
    """Counterfactual arrays to (id, rank, reached, feature, original, value); a row that reached nothing has no values."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("x", F.lit(i)).alias("original"),
                              F.get("z", F.lit(i)).alias("value")) for i, f in enumerate(features)])
    return found.select(id_column, "rank", "reached", F.explode(rows).alias("r")).select(id_column, "rank", "reached", "r.*")


def change_analysis(changes: DataFrame, id_column: str) -> DataFrame:
    """Per row and feature that changed: how often, and mean, least and largest change."""
    delta = F.col("value") - F.col("original")
    return changes.groupBy(id_column, "feature").agg(
        (F.count_if(F.col("value") != F.col("original")) / F.count(F.lit(1))).alias("change_frequency"),
        F.first("original").alias("original_value"), F.avg(delta).alias("average_change"),
        F.min(delta).alias("min_change"), F.max(delta).alias("max_change")).where("change_frequency > 0")


def insights(analysis: DataFrame, id_column: str, top: int = 5) -> DataFrame:
    """Sentences for the features changed in most counterfactuals of a row."""
    item = F.struct((-F.col("change_frequency")).alias("k"), "feature", "original_value", "average_change", "change_frequency")
    rows = analysis.groupBy(id_column).agg(F.slice(F.array_sort(F.collect_list(item)), 1, top).alias("items"))

    # The wording of the sentence.
    def sentence(x: Column) -> Column:
        verb = F.when(x["average_change"] > 0, "increasing").otherwise("reducing")
        return F.format_string("To change the prediction, consider %s %s from %.3f (changed in %.1f%% of counterfactuals)",
                               verb, x["feature"], x["original_value"], x["change_frequency"] * 100)

    majority = F.filter("items", lambda x: x["change_frequency"] > 0.5)
    return rows.select(id_column, F.transform(majority, sentence).alias("insights"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(moments: pd.Series) -> pd.Series:
    """Ridge solution of small normal equations given as the flat upper triangle of [X y]' W [X y]."""
    out = []
    for flat in moments:
        size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = flat
        full = full + np.triu(full, 1).T
        a, y = full[:-1, :-1] + 1e-6 * np.eye(size - 1), full[:-1, -1]
        out.append(np.linalg.solve(a, y).tolist())
    return pd.Series(out)


def local_surrogates(model: Model, df: DataFrame, id_column: str, features: Sequence[str], reference: DataFrame,
                     samples: int = 200, seed: int = 42) -> DataFrame:
    """Weighted linear fit around each row (LIME): weight per feature and intercept.

    Perturbations are exploded and scored in one transform; each row's normal
    equations are sums, combined on the map side, and only the solved system of
    a few numbers reaches Python.
    """
    d = len(features)
    scale = reference.agg(F.array(*[F.coalesce(F.nullif(F.stddev_pop(F.col(f).cast("double")), F.lit(0.0)), F.lit(1.0))
                                    for f in features]).alias("s")).scalar()
    tries = dealt_out(df, id_column).select(F.col(id_column).alias("id"), feature_array(df, features).alias("x"), scale.alias("s"),
                                            F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("n"))

    def normal(i: Column) -> Column:
        u = F.greatest(uniform(F.lit(seed), F.col("id"), F.col("n"), i, F.lit("u")), F.lit(1e-12))
        v = uniform(F.lit(seed), F.col("id"), F.col("n"), i, F.lit("v"))
        return F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * v)

    # The first sample is the row itself. A column per feature, so that samples are made by compiled code.
    noise = [f"e{i}" for i in range(d)]
    tries = tries.select("*", *[F.when(F.col("n") == 0, 0.0).otherwise(normal(F.lit(i))).alias(e) for i, e in enumerate(noise)])
    moved = F.array(*[F.get("x", F.lit(i)) + F.col(e) * F.get("s", F.lit(i)) for i, e in enumerate(noise)])
    scored = class_one(model, tries.select("id", "n", *noise, moved.alias("z")), F.col("z"))
    width2 = F.lit((0.75 * np.sqrt(d)) ** 2)
    square = F.lit(0.0)
    for e in noise:
        square = square + F.col(e) * F.col(e)
    row = scored.withColumn("w", F.exp(-square / width2))
    q = [F.lit(1.0), *map(F.col, noise), F.col("f")]
    terms = [F.sum(F.col("w") * q[i] * q[j]).alias(f"m{i}_{j}") for i in range(d + 2) for j in range(i, d + 2)]
    sums = row.groupBy("id").agg(*terms, F.max(F.when(F.col("n") == 0, F.col("f"))).alias("score"))
    flat = F.array(*[f"m{i}_{j}" for i in range(d + 2) for j in range(i, d + 2)])
    solved = sums.select("id", "score", _solve(flat).alias("beta"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("beta", F.lit(i + 1)).alias("weight"))
                      for i, f in enumerate(features)])
    return solved.select(F.col("id").alias(id_column), "score", F.get("beta", F.lit(0)).alias("intercept"),
                         F.explode(pairs).alias("r")).select(id_column, "score", "intercept", "r.*")


# Fixed value: closing note of a summary.
COMPLIANCE = ("**Compliance Note:** This explanation is generated using interpretable methods "
              "(attributions, local surrogates, counterfactuals).")


def combined_explanations(scores: DataFrame, id_column: str, texts: DataFrame, advice: DataFrame | None = None,
                          surrogates: DataFrame | None = None) -> DataFrame:
    """Score, attribution text, advice and surrogate weights of a row joined, with a summary."""
    out = scores.select(id_column, "score").join(texts.select(id_column, "text"), id_column, "left")
    if advice is not None:
        out = out.join(advice, id_column, "left")
    else:
        out = out.withColumn("insights", F.lit(None).cast("array<string>"))
    if surrogates is not None:
        weights = surrogates.groupBy(id_column).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "weight")))).alias("surrogate_weights"))
        out = out.join(weights, id_column, "left")
    p = F.col("score")
    # The wording of the summary.
    head = F.format_string("**Prediction:** %s (Confidence: %.1f%%, Risk Level: %s)",
                           F.when(p > 0.5, "FRAUD").otherwise("NOT FRAUD"), p * 100, _level(p, SUMMARY_LEVELS))
    recommended = F.when(F.size("insights") > 0, F.concat(F.lit("**Actionable Recommendations:**\n"), F.array_join(
        F.transform(F.slice("insights", 1, 3), lambda s: F.concat(F.lit("- "), s)), "\n")))
    summary = F.concat_ws("\n", head, F.col("text"), recommended, F.lit(COMPLIANCE))
    return out.withColumn("prediction", (p > 0.5).cast("int")).withColumn("summary", summary)


def model_report(scores: DataFrame, attributions: DataFrame | None = None, top: int = 20) -> dict[str, DataFrame]:
    """Report tables for scored rows with ``score``, ``prediction`` and ``label``."""
    out = {"class_report": metrics.class_report(scores), "confusion": metrics.confusion(scores), "auc": metrics.auc(scores)}
    if attributions is not None:
        out["top_features"] = global_importance(attributions).orderBy(F.desc("abs_importance"), "feature").limit(top)
    return out


def save_explanations(explanations: DataFrame, path: str, if_exists: str = "replace") -> None:
    """One JSON document per row."""
    mode = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}[if_exists]
    explanations.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def load_explanations(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
