"""Running totals that do not put one key's whole history into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in a single task,
which fails when one customer owns a third of the table. Here a key's rows are
cut into time buckets: the window runs inside (key, bucket), and the state at
the start of a bucket comes from per-bucket sums, which are pre-aggregated on
the map side and few per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.times import HOUR_US, micros

_BUCKET = "__bucket"
_US = "__us"


def _bucketed(df: DataFrame, ts: str, bucket_us: int) -> DataFrame:
    return df.withColumn(_US, micros(ts)).withColumn(
        _BUCKET, F.floor(F.col(_US) / F.lit(bucket_us)).cast("bigint")
    )


def _with_prefix(local: DataFrame, source: DataFrame, keys: Sequence[str],
                 sums: Mapping[str, Column], lasts: Mapping[str, Column],
                 order: Sequence[str]) -> DataFrame:
    """Join to each bucket the sums (``__p_``) and last values (``__q_``) before it."""
    part = [*keys, _BUCKET]
    aggs = [F.sum(e).alias("__s_" + n) for n, e in sums.items()]
    aggs += [F.max_by(e, F.struct(*order)).alias("__t_" + n) for n, e in lasts.items()]
    totals = source.groupBy(*part).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(_BUCKET)
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *part,
        *[F.sum("__s_" + n).over(upto).alias("__p_" + n) for n in sums],
        *[F.lag("__t_" + n).over(before).alias("__q_" + n) for n in lasts],
    )
    return local.join(prefix, part)


def running(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], *,
            sums: Mapping[str, Column] | None = None,
            lags: Mapping[str, Column] | None = None,
            bucket_us: int = HOUR_US) -> DataFrame:
    """Inclusive running sums and previous-row values along (ts, *order)."""
    sums, lags = dict(sums or {}), dict(lags or {})
    full_order = [_US, *order]
    source = _bucketed(df, ts, bucket_us)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*full_order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = source.select(
        "*",
        *[F.sum(e).over(upto).alias("__l_" + n) for n, e in sums.items()],
        *[F.lag(e).over(inside).alias("__g_" + n) for n, e in lags.items()],
        F.row_number().over(inside).alias("__rn"),
    )
    joined = _with_prefix(local, source, keys, sums, lags, full_order)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col("__l_" + n), F.lit(0)) + F.coalesce(F.col("__p_" + n), F.lit(0))).alias(n)
          for n in sums],
        *[F.when(F.col("__rn") == 1, F.col("__q_" + n)).otherwise(F.col("__g_" + n)).alias(n)
          for n in lags],
    )


def ranked(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], out: str = "rank") -> DataFrame:
    """Row number of each row within its key by ascending value.

    The window runs inside logarithmic value buckets; bucket sizes give the offset.
    """
    from riskspark.functions.quantiles import value_bucket
    source = df.withColumn(_BUCKET, value_bucket(F.col(value)))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(value, *ties)
    local = source.withColumn("__l_rank", F.row_number().over(inside))
    joined = _with_prefix(local, source, keys, {"rank": F.lit(1)}, {}, [])
    return joined.select(*df.columns, (F.col("__l_rank") + F.coalesce("__p_rank", F.lit(0))).cast("bigint").alias(out))


def below(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Per row of distinct (keys, value): the sum of ``weight`` over smaller values of its key.

    Count equal values together first; then no number of ties meets in one task.
    """
    from riskspark.functions.quantiles import value_bucket
    source = df.withColumn(_BUCKET, value_bucket(F.col(value)))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = source.withColumn("__l_w", F.sum(weight).over(inside))
    joined = _with_prefix(local, source, keys, {"w": F.col(weight)}, {}, [])
    return joined.select(*df.columns, (F.coalesce("__l_w", F.lit(0)) + F.coalesce("__p_w", F.lit(0))).alias(out))


def strictly_before(df: DataFrame, keys: Sequence[str], ts: str, *,
                    counts: str | None = None, latest: str | None = None,
                    bucket_us: int = HOUR_US) -> DataFrame:
    """Per row: how many rows of the key lie strictly earlier, and the latest such time.

    Rows at the same instant are not earlier than each other.
    """
    source = _bucketed(df, ts, bucket_us)
    part = [*keys, _BUCKET]
    earlier = (Window.partitionBy(*part).orderBy(_US)
               .rangeBetween(Window.unboundedPreceding, -1))
    local = source.select("*", F.count(F.lit(1)).over(earlier).alias("__n"),
                          F.max(_US).over(earlier).alias("__m"))
    totals = source.groupBy(*part).agg(F.count(F.lit(1)).alias("__s"), F.max(_US).alias("__t"))
    before = Window.partitionBy(*keys).orderBy(_BUCKET)
    prefix = totals.select(
        *part,
        F.sum("__s").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("__ps"),
        F.lag("__t").over(before).alias("__pt"),
    )
    out = local.join(prefix, part)
    extra = []
    if counts:
        extra.append((F.col("__n") + F.coalesce("__ps", F.lit(0))).cast("bigint").alias(counts))
    if latest:
        extra.append(F.coalesce("__m", "__pt").alias(latest))
    return out.select(*df.columns, *extra)


def asof_sums(events: DataFrame, probes: DataFrame, keys: Sequence[str], *,
              event_us: str, probe_us: str, inclusive: str,
              sums: Mapping[str, Column], bucket_us: int = HOUR_US) -> DataFrame:
    """For every probe row, the sums over its key's events up to the probe time.

    ``inclusive`` names a boolean probe column: true counts events at exactly
    the probe time, false leaves them out. Events and probes travel in one
    tagged union, so there is no range join.
    """
    payload = [c for c in probes.columns if c not in keys]
    left = events.select(
        *keys, F.col(event_us).alias(_US), F.lit(0).alias("__seq"),
        *[e.alias("__v_" + n) for n, e in sums.items()],
        F.lit(None).cast(probes.select(F.struct(*payload).alias("p")).schema["p"].dataType).alias("__payload"),
    )
    right = probes.select(
        *keys, F.col(probe_us).alias(_US),
        F.when(F.col(inclusive), F.lit(1)).otherwise(F.lit(-1)).alias("__seq"),
        *[F.lit(0).cast(left.schema["__v_" + n].dataType).alias("__v_" + n) for n in sums],
        F.struct(*payload).alias("__payload"),
    )
    both = left.unionByName(right).withColumn(
        _BUCKET, F.floor(F.col(_US) / F.lit(bucket_us)).cast("bigint"))
    upto = (Window.partitionBy(*keys, _BUCKET).orderBy(_US, "__seq")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = both.select("*", *[F.sum("__v_" + n).over(upto).alias("__l_" + n) for n in sums])
    local = local.filter(F.col("__seq") != 0)
    joined = _with_prefix(local, both, keys, {n: F.col("__v_" + n) for n in sums}, {}, [_US])
    return joined.select(
        *keys, "__payload.*",
        *[(F.coalesce(F.col("__l_" + n), F.lit(0)) + F.coalesce(F.col("__p_" + n), F.lit(0))).alias(n)
          for n in sums],
    )


def first_after(rows: DataFrame, keys: Sequence[str], us: str, delta_us: int, out: str,
                bucket_us: int = HOUR_US) -> DataFrame:
    """Per row: the smallest time of its key more than ``delta_us`` later (null if none)."""
    events = rows.select(*keys, F.col(us).alias(_US), F.lit(0).alias("__probe"), F.col(us).alias("__seen"),
                         F.lit(None).cast("bigint").alias("__from"))
    probes = rows.select(*keys, (F.col(us) + delta_us).alias(_US), F.lit(1).alias("__probe"),
                         F.lit(None).cast("bigint").alias("__seen"), F.col(us).alias("__from"))
    both = events.unionByName(probes).withColumn(_BUCKET, F.floor(F.col(_US) / F.lit(bucket_us)).cast("bigint"))
    # Backwards in time, a probe before the events at its own instant.
    later = (Window.partitionBy(*keys, _BUCKET).orderBy(F.desc(_US), F.desc("__probe"))
             .rowsBetween(Window.unboundedPreceding, -1))
    local = both.withColumn("__near", F.min("__seen").over(later)).where("__probe = 1")
    starts = both.groupBy(*keys, _BUCKET).agg(F.min("__seen").alias("__start"))
    beyond = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(1, Window.unboundedFollowing)
    starts = starts.select(*keys, _BUCKET, F.first("__start", ignorenulls=True).over(beyond).alias("__next"))
    return local.join(starts, [*keys, _BUCKET]).select(
        *keys, F.col("__from").alias(us), F.coalesce("__near", "__next").alias(out))


def stretch_moves(occurrences: DataFrame, keys: Sequence[str], windows: Mapping[str, int]) -> DataFrame:
    """(keys, w, us, d, stretch): when each group of ``keys`` comes alive (+1) and expires (-1).

    A group is alive just before T if it occurred in ``T - window <= us < T``; windows are in
    hours, none shorter than one. Occurrences less than an hour apart never end a stretch, so
    they are reduced to the first and last one of an hour on the map side. ``stretch`` is the
    same for both moves of a stretch.
    """
    hours = (occurrences.groupBy(*keys, F.floor(F.col("us") / HOUR_US).alias("__hour"))
             .agg(F.min("us").alias("__first"), F.max("us").alias("__last")))
    along = Window.partitionBy(*keys).orderBy("__hour")
    gaps = hours.withColumns({"__before": F.lag("__last").over(along), "__after": F.lead("__first").over(along)})
    rows = []
    for w, h in windows.items():
        width = F.lit(h * HOUR_US).cast("bigint")
        opens = F.col("__before").isNull() | (F.col("__first") - F.col("__before") > width)
        closes = F.col("__after").isNull() | (F.col("__after") - F.col("__last") > width)
        gaps = gaps.withColumn(f"__s_{w}", F.sum(opens.cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        rows += [F.when(opens, F.struct(F.lit(w).alias("w"), F.col("__first").alias("us"), F.lit(1).alias("d"), F.col(f"__s_{w}").alias("stretch"))),
                 F.when(closes, F.struct(F.lit(w).alias("w"), (F.col("__last") + width).alias("us"), F.lit(-1).alias("d"),
                                         F.col(f"__s_{w}").alias("stretch")))]
    moves = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return gaps.select(*keys, F.explode(moves).alias("__m")).select(*keys, "__m.*")
