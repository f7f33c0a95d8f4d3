"""Contextual features: the transaction seen against its customer's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.quantiles import exact_percentiles
from riskspark.functions.times import micros, within
from riskspark.plans.fixpoint import cut
from riskspark.plans.nearest import EARTH_KM, great_circle_km, nearest
from riskspark.plans.running import strictly_before

# Distance without history in km, minutes without an earlier transaction that day.
NO_HISTORY_KM = 1000.0
NO_EARLIER_MINUTES = 1440
DAYS_90 = 90 * 24
#: Grid cells of a customer's places beyond which the grid is descended.
MANY_CELLS = 256


def is_night(ts: Column, night: str = "strict") -> Column:
    """``strict``: before 6 or after 22; ``wide``: from 22 to 6 inclusive."""
    hour = F.hour(ts)
    return (hour < 6) | (hour > 22) if night == "strict" else (hour >= 22) | (hour <= 6)


def _flags(night: str) -> dict[str, Column]:
    ts, amount = F.col("timestamp"), F.col("amount").cast("double")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return {
        "transaction_amount": amount,
        "is_round_amount": flag(amount % 1 == 0),
        "is_weekend": flag(F.weekday(ts) >= 5),
        "hour_of_day": F.hour(ts),
        "is_night_transaction": flag(is_night(ts, night)),
        "is_mobile_channel": flag(F.col("channel") == "mobile_app"),
        "is_web_channel": flag(F.col("channel") == "web_browser"),
        "is_atm_channel": flag(F.col("channel") == "atm")}


def transaction_flags(transactions: DataFrame, night: str = "strict") -> DataFrame:
    """Amount, calendar and channel flags per transaction."""
    return transactions.select("transaction_id", "customer_id", *[c.alias(n) for n, c in _flags(night).items()])


def with_flags(transactions: DataFrame) -> DataFrame:
    """``transactions`` with the amount, calendar and channel flags."""
    return transactions.withColumns(_flags("strict"))


SAME_DAY_COLUMNS = ["transactions_today", "minutes_since_last_transaction"]


def with_same_day(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``rows`` with the minutes since the previous transaction of the day and how many came before.

    Earlier rows are those of ``history``, and of ``rows`` where they are not
    stored yet, so the answer does not depend on how a stream is cut. Only days that
    ``rows`` touches are read from ``history``.
    """
    columns = rows.columns
    both = rows.withColumn("__asked", F.lit(True))
    if history is not None:
        first, last = rows.agg(F.to_date(F.min("timestamp")), F.max("timestamp")).first()
        if first is not None:
            stored = history.where((F.col("timestamp") >= F.lit(first).cast("timestamp_ntz")) & (F.col("timestamp") <= F.lit(last)))
            stored = (stored.select("transaction_id", "customer_id", "timestamp")
                      .join(rows.select("transaction_id"), "transaction_id", "left_anti").withColumn("__asked", F.lit(False)))
            both = both.unionByName(stored, allowMissingColumns=True)
    seen = strictly_before(both.withColumn("__day", F.to_date("timestamp")), ["customer_id", "__day"], "timestamp",
                           counts="transactions_today", latest="__previous").where("__asked")
    gap_seconds = F.round((micros("timestamp") - F.col("__previous")) / 1_000_000)
    return seen.select(*columns, "transactions_today", F.coalesce(F.floor(gap_seconds / 60), F.lit(NO_EARLIER_MINUTES))
                       .cast("bigint").alias("minutes_since_last_transaction"))


def same_day_history(transactions: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Minutes since the previous transaction of the day and how many came before."""
    rows = transactions.select("transaction_id", "customer_id", "timestamp")
    return with_same_day(rows, other_rows(transactions, history)).select("transaction_id", *SAME_DAY_COLUMNS)


def other_rows(transactions: DataFrame, history: DataFrame | None) -> DataFrame | None:
    """The history unless it is the transactions themselves."""
    return None if history is None or history.sameSemantics(transactions) else history


def nearest_usual_location(transactions: DataFrame, history: DataFrame, as_of,
                           hours: int = DAYS_90, cell_degrees: float = 0.5) -> DataFrame:
    """Kilometres from each transaction to the customer's nearest location in the window."""
    return with_location(transactions, history, as_of, hours, cell_degrees).select(
        "transaction_id", "distance_from_usual_location_km")


def with_location(transactions: DataFrame, history: DataFrame, as_of, hours: int = DAYS_90, cell_degrees: float = 0.5) -> DataFrame:
    """``transactions`` with the kilometres from each transaction to the customer's nearest location in the window.

    Places are reduced to distinct (customer, latitude, longitude) first, and a place
    already in the history needs no search. For the others, history is grouped
    into grid cells; cells whose nearest possible point is farther than a known
    point are skipped. Customers whose places fill more than ``MANY_CELLS`` cells are
    searched by descending a grid of several levels instead of looking at each cell.
    Both ways are exact.
    """
    place = ["customer_id", "location_lat", "location_lon"]
    has_place = F.col("location_lat").isNotNull() & F.col("location_lon").isNotNull()
    known = history.where(has_place & within("timestamp", as_of, hours)).select(*place).distinct()
    asked = transactions.where(has_place).select(*place).distinct()
    new = asked.join(known, place, "left_anti")

    step = F.lit(float(cell_degrees))
    cell = ["__cy", "__cx"]
    celled = (known.withColumn("__cy", F.floor(F.col("location_lat") / step))
              .withColumn("__cx", F.floor(F.col("location_lon") / step)))
    cells = celled.groupBy("customer_id", *cell).agg(
        F.min("location_lat").alias("s"), F.max("location_lat").alias("n"),
        F.min("location_lon").alias("w"), F.max("location_lon").alias("e"),
        F.min(F.struct("location_lat", "location_lon")).alias("sample"))
    lat, lon = F.col("location_lat"), F.col("location_lon")

    def outside(x: Column, low: Column, high: Column) -> Column:
        return F.greatest(low - x, x - high, F.lit(0.0))

    around = F.least(outside(lon, F.col("w"), F.col("e")),
                     outside(lon + 360, F.col("w"), F.col("e")),
                     outside(lon - 360, F.col("w"), F.col("e")))
    sin_lat = F.sin(F.radians(outside(lat, F.col("s"), F.col("n"))) / 2)
    sin_lon = F.sin(F.radians(F.least(around, F.lit(180.0))) / 2)
    cos_cell = F.least(F.cos(F.radians("s")), F.cos(F.radians("n")))
    at_least = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0),
        sin_lat * sin_lat + F.cos(F.radians(lat)) * cos_cell * sin_lon * sin_lon)))
    to_sample = great_circle_km(lat, lon, F.col("sample.location_lat"), F.col("sample.location_lon"))
    many = cut(cells.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_CELLS).select("customer_id"))
    descended = None
    if not many.isEmpty():
        asked = cut(new.join(many, "customer_id", "left_semi").select(
            F.struct(*place).alias("probe"), "customer_id", F.col("location_lat").alias("lat"), F.col("location_lon").alias("lon")))
        places = known.join(many, "customer_id", "left_semi").select(
            "customer_id", F.col("location_lat").alias("lat"), F.col("location_lon").alias("lon"))
        descended = nearest(asked, cut(places)).select("probe.*", "km")
        new = new.join(many, "customer_id", "left_anti")
    bounds = new.join(cells, "customer_id").select(
        *place, *cell, at_least.alias("at_least"), to_sample.alias("to_sample"))
    best = bounds.groupBy(*place).agg(F.min("to_sample").alias("best"))
    # A metre of slack keeps rounding from dropping the right cell.
    near = bounds.join(best, place).where(F.col("at_least") <= F.col("best") + 0.001).select(*place, *cell)
    points = celled.select("customer_id", *cell, F.col("location_lat").alias("y"),
                           F.col("location_lon").alias("x"))
    found = (near.join(points, ["customer_id", *cell])
             .groupBy(*place).agg(F.min(great_circle_km(lat, lon, F.col("y"), F.col("x"))).alias("km")))
    all_found = known.withColumn("km", F.lit(0.0)).unionByName(found)
    if descended is not None:
        all_found = all_found.unionByName(descended)
    columns = transactions.columns
    return (transactions.join(all_found.withColumnRenamed("km", "__km"), place, "left")
            .select(*columns,
                    F.when(~has_place, 0.0).otherwise(F.coalesce("__km", F.lit(NO_HISTORY_KM)))
                    .alias("distance_from_usual_location_km")))


def amount_baseline(history: DataFrame, as_of, hours: int = DAYS_90) -> DataFrame:
    """Mean, sample deviation, maximum and exact 95th percentile of approved amounts."""
    rows = history.where((F.col("status") == "approved") & within("timestamp", as_of, hours)) \
        .select("customer_id", F.col("amount").cast("double").alias("amount"))
    stats = rows.groupBy("customer_id").agg(
        F.avg("amount").alias("avg_amount"), F.stddev_samp("amount").alias("std_amount"),
        F.max("amount").alias("max_amount"))
    return stats.join(exact_percentiles(rows, ["customer_id"], "amount", {"p95_amount": 0.95}),
                      "customer_id", "left")


DEVIATION_COLUMNS = ["amount_zscore", "amount_vs_p95_ratio", "amount_vs_max_ratio", "is_amount_above_p95"]


def with_deviation(transactions: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """``transactions`` with how far the amount is from its customer's history; every divisor is at least 1."""
    base = amount_baseline(history, as_of)
    base = base.select("customer_id", F.struct(*base.columns[1:]).alias("__base"))
    return deviations(transactions.join(base, "customer_id", "left"), transactions.columns)


def deviations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the deviation columns of rows that carry their baseline in ``__base``."""
    amount = F.col("amount").cast("double")

    def known(name: str, default: float) -> Column:
        return F.coalesce("__base." + name, F.lit(default))

    def at_least_one(column: Column) -> Column:
        return F.greatest(column, F.lit(1.0))

    return rows.select(
        *columns,
        ((amount - known("avg_amount", 0.0)) / at_least_one(known("std_amount", 1.0))).alias("amount_zscore"),
        (amount / at_least_one(known("p95_amount", 0.0))).alias("amount_vs_p95_ratio"),
        (amount / at_least_one(known("max_amount", 0.0))).alias("amount_vs_max_ratio"),
        (amount > known("p95_amount", 0.0)).cast("int").alias("is_amount_above_p95"))


def amount_deviation(transactions: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """How far an amount is from its customer's history."""
    return with_deviation(transactions.select("transaction_id", "customer_id", "amount"), history, as_of).select(
        "transaction_id", *DEVIATION_COLUMNS)


def with_context(transactions: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """``transactions`` with the whole contextual pillar.

    The row is carried through: one exchange for the day, one for the
    customer's amounts and one for its places, and no join back on the id.
    """
    rows = with_flags(transactions)
    rows = with_same_day(rows, other_rows(transactions, history))
    return with_deviation(with_location(rows, history, as_of), history, as_of)


def contextual_features(transactions: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """The whole contextual pillar, one row per transaction."""
    rows = with_context(transactions, history, as_of)
    return rows.select("transaction_id", "customer_id", *_flags("strict"), *SAME_DAY_COLUMNS,
                       "distance_from_usual_location_km", *DEVIATION_COLUMNS)
