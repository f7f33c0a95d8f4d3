"""Many trailing windows from one scan.

All windows end at ``as_of``. A row's age against it is computed once; a window
is then a comparison of that number. A distinct value belongs to a window
exactly when its youngest row does, so distinct counts become a last-seen table
plus conditional counts, and sums become conditional aggregates of one grouping.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.times import HOUR_US, WINDOW_HOURS, as_time, micros, within

AGE = "__age_us"


def clip(df: DataFrame, ts: str, as_of, windows: Mapping[str, int]) -> DataFrame:
    """Rows of the widest window; the bounds reach the scan as pushed filters."""
    return df.where(within(ts, as_of, max(windows.values())))


def with_age(df: DataFrame, ts: str, as_of) -> DataFrame:
    """Add each row's age against ``as_of`` in microseconds."""
    return df.withColumn(AGE, micros(as_time(as_of)) - micros(ts))


def windowed(df: DataFrame, key: str, ts: str, as_of, windows: Mapping[str, int],
             measures: Mapping[str, str], clipped: bool = True) -> DataFrame:
    """One grouping with ``{name}_{window}`` columns; ``{w}`` in a name places the window itself.

    A measure is SQL text in which ``{in}`` stands for "the row lies in the window".
    """
    rows = with_age(clip(df, ts, as_of, windows) if clipped else df, ts, as_of)
    aggs = []
    for w, hours in windows.items():
        inside = f"{AGE} <= {hours * HOUR_US}"
        for name, text in measures.items():
            full = name.replace("{w}", w) if "{w}" in name else f"{name}_{w}"
            aggs.append(F.expr(f"{text.replace('{in}', inside)} AS `{full}`"))
    return rows.groupBy(key).agg(*aggs)


def distinct_in_windows(df: DataFrame, key: str, ts: str, as_of,
                        values: Mapping[str, Column],
                        windows: Mapping[str, int] = WINDOW_HOURS) -> DataFrame:
    """Columns ``{name}_{window}``: distinct non-null values of each expression."""
    pairs = F.array(*[F.struct(F.lit(i).alias("kind"), e.cast("string").alias("value"))
                      for i, e in enumerate(values.values())])
    seen = (with_age(clip(df, ts, as_of, windows), ts, as_of)
            .select(key, AGE, F.explode(pairs).alias("p"))
            .where("p.value IS NOT NULL")
            .groupBy(key, F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
            .agg(F.min(AGE).alias("youngest")))
    return seen.groupBy(key).agg(*[
        F.expr(f"count_if(kind = {i} AND youngest <= {h * HOUR_US}) AS `{n}_{w}`")
        for i, n in enumerate(values) for w, h in windows.items()])
