"""Exact interpolated percentiles for groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here a group is first counted into logarithmic value
buckets (a bounded number per group); only the rows of the buckets that hold a
wanted rank are looked at again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 512          # buckets per e-fold of the value
_SHIFT = 800 * _STEPS  # keeps buckets of small positive values above zero


def value_bucket(v: Column) -> Column:
    """Bucket number that rises with the value, about 0.2 % wide."""
    magnitude = F.floor(F.ln(F.abs(v)) * _STEPS) + F.lit(_SHIFT)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * magnitude).cast("bigint")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      probs: Mapping[str, float], nearest: set[str] = frozenset()) -> DataFrame:
    """One row per group with a column per wanted percentile.

    Percentiles are interpolated between neighbours; those named in ``nearest``
    take the value at index ``floor(p * n)`` (the last one at most).
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__v")).withColumn("__b", value_bucket(F.col("__v")))
    sizes = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys)
    sizes = sizes.select(
        *keys, "__b",
        (F.sum("__n").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__n")).alias("__before"),
        F.col("__n"), F.sum("__n").over(whole).alias("__total"))

    def ranks(name: str, p: float) -> tuple[Column, Column]:
        if name in nearest:
            place = F.least(F.floor(F.col("__total") * F.lit(float(p))) + 1, F.col("__total"))
            return place, place
        position = (F.col("__total") - 1) * F.lit(float(p))
        return F.floor(position) + 1, F.ceil(position) + 1

    def holds(rank: Column, before: Column, upto: Column) -> Column:
        return (before < rank) & (rank <= upto)

    wanted = F.lit(False)
    for name, p in probs.items():
        for rank in ranks(name, p):
            wanted = wanted | holds(rank, F.col("__before"), F.col("__before") + F.col("__n"))
    targets = sizes.where(wanted).drop("__n")
    counted = (rows.join(targets, [*keys, "__b"])
               .groupBy(*keys, "__b", "__before", "__total", "__v")
               .agg(F.count(F.lit(1)).alias("__n")))
    inner = Window.partitionBy(*keys, "__b").orderBy("__v")
    counted = counted.withColumn(
        "__upto", F.col("__before")
        + F.sum("__n").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    picks = []
    for name, p in probs.items():
        lo, hi = ranks(name, p)
        start = F.col("__upto") - F.col("__n")
        low = F.max(F.when(holds(lo, start, F.col("__upto")), F.col("__v")))
        high = F.max(F.when(holds(hi, start, F.col("__upto")), F.col("__v")))
        fraction = F.max((F.col("__total") - 1) * F.lit(float(p))
                         - F.floor((F.col("__total") - 1) * F.lit(float(p))))
        picks.append((low + (high - low) * fraction).alias(name))
    return counted.groupBy(*keys).agg(*picks)
