"""Nearest known place of a customer, found by descending a grid.

A cell of one level is cut into sixteen on the next. A place in a cell is at most the cell's
radius from its centre, so the distance to the centre bounds the distance to every
place in it from both sides. Starting from the largest cells, a probe keeps the cells whose
least distance is not beyond the best upper bound, and looks at their occupied parts
on the next level, until the cells hold few places. What it keeps is a handful of cells around the nearest place, whatever
the number of places, so work grows with probes and places and not with their product.

Two kinds of history: all known places (``nearest``), or those visited in the hours before
each probe's own time (``nearest_before``), where the occupied parts of a cell come from running
counts of cells that come alive and expire.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.times import HOUR_US
from riskspark.plans.fixpoint import cut
from riskspark.plans.running import asof_sums, stretch_moves

EARTH_KM = 6371.0
#: Levels below the whole globe; cells of the last one are about 40 m wide.
LEVELS = 10
#: Places a cell holds on average where all of them are looked at.
FEW = 128
#: A kilometre's thousandth of slack keeps rounding from dropping the right cell.
SLACK = 0.001


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Spherical law of cosines; the argument is clamped against rounding."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(a) * F.sin(b)
    return F.lit(EARTH_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def width(level: int) -> float:
    """Width of a cell in degrees."""
    return 360.0 / 4 ** level


def cell(level: int, lat: str = "lat", lon: str = "lon") -> tuple[Column, Column]:
    return tuple(F.floor(F.col(c) / F.lit(width(level))).alias(n) for c, n in ((lat, "cy"), (lon, "cx")))


def _bounded(rows: DataFrame, level: int) -> DataFrame:
    """Cells (cy, cx) of ``level`` with ``least`` and ``most``, cut to those that may hold the nearest place."""
    w = width(level)
    centre = great_circle_km(F.col("lat"), F.col("lon"), (F.col("cy") + 0.5) * w, (F.col("cx") + 0.5) * w)
    radius = EARTH_KM * w * 3.141592653589793 / 180
    rows = rows.withColumn("km", centre).withColumns({"least": F.col("km") - radius, "most": F.least(F.col("km") + radius, F.col("sample_km"))})
    best = rows.groupBy("probe").agg(F.min("most").alias("best"))
    return cut(rows.join(best, "probe").where(F.col("least") <= F.col("best") + SLACK).select("probe", "customer_id", "lat", "lon", *_times(rows), "cy", "cx"))


def _times(rows: DataFrame) -> list[str]:
    return [c for c in ("us",) if c in rows.columns]


def _descend(probes: DataFrame, places: DataFrame, expand: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, int]:
    """Cells that may hold a probe's nearest place, and their level: the first one where such a cell holds
    ``FEW`` of ``places`` on average, or the last one."""
    state = probes.select("probe", "customer_id", "lat", "lon", *_times(probes))
    around = F.explode(F.array(F.lit(-1), F.lit(0)).cast("array<bigint>"))
    state = state.withColumn("cy", around).withColumn("cx", around)
    for level in range(1, LEVELS + 1):
        state = _bounded(expand(state, level), level)
        held = places.select("customer_id", *cell(level, "y", "x")).groupBy("customer_id", "cy", "cx").agg(F.count(F.lit(1)).alias("n"))
        cells, met = state.join(held, ["customer_id", "cy", "cx"]).agg(F.count(F.lit(1)), F.sum("n")).first()
        if (met or 0) <= FEW * cells:
            break
    return state, level


def nearest(probes: DataFrame, known: DataFrame) -> DataFrame:
    """(probe, km) for each of ``probes`` (probe, customer_id, lat, lon) whose customer has a place in
    ``known`` (customer_id, lat, lon)."""
    def expand(state: DataFrame, level: int) -> DataFrame:
        occupied = known.select("customer_id", "lat", "lon", *cell(level)).groupBy("customer_id", "cy", "cx").agg(
            F.min(F.struct("lat", "lon")).alias("sample"))
        occupied = occupied.select(F.col("customer_id").alias("__c"), F.floor(F.col("cy") / 4).alias("__y"), F.floor(F.col("cx") / 4).alias("__x"),
                                   F.col("cy").alias("__cy"), F.col("cx").alias("__cx"), "sample")
        met = state.join(occupied, (F.col("customer_id") == F.col("__c")) & (F.col("cy") == F.col("__y")) & (F.col("cx") == F.col("__x")))
        return met.select("probe", "customer_id", "lat", "lon", F.col("__cy").alias("cy"), F.col("__cx").alias("cx"),
                          great_circle_km(F.col("lat"), F.col("lon"), F.col("sample.lat"), F.col("sample.lon")).alias("sample_km"))

    places = known.select("customer_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    state, level = _descend(probes, places, expand)
    left = state.join(places.select("*", *cell(level, "y", "x")), ["customer_id", "cy", "cx"])
    return left.groupBy("probe").agg(F.min(great_circle_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).alias("km"))


def nearest_before(probes: DataFrame, visits: DataFrame, hours: int) -> DataFrame:
    """(probe, km) for each of ``probes`` (probe, customer_id, lat, lon, us) whose customer was somewhere in the
    ``hours`` before ``us``; ``visits``: customer_id, lat, lon, us."""
    # A place visited at least once an hour is one stretch; hours reduce on the map side.
    window = {"w": hours}
    own = cut(stretch_moves(visits.select("customer_id", F.struct("lat", "lon").alias("value"), "us"), ["customer_id", "value"], window))
    asked = probes.select("probe", "customer_id", F.struct("lat", "lon").alias("value"), "us").withColumn("inclusive", F.lit(False))
    here = asof_sums(own.select("customer_id", "value", "us", "d"), asked, ["customer_id", "value"], event_us="us", probe_us="us",
                     inclusive="inclusive", sums={"alive": F.col("d").cast("bigint")})
    here = cut(here.where("alive > 0").select("probe"))
    searched = cut(probes.select("probe", "customer_id", "lat", "lon", "us").join(here, "probe", "left_anti"))

    def expand(state: DataFrame, level: int) -> DataFrame:
        seen = visits.select("customer_id", *cell(level), "us").select("customer_id", F.struct("cy", "cx").alias("value"), "us")
        moves = stretch_moves(seen, ["customer_id", "value"], window).select(
            "customer_id", F.floor(F.col("value.cy") / 4).alias("cy"), F.floor(F.col("value.cx") / 4).alias("cx"),
            (F.pmod("value.cy", F.lit(4)) * 4 + F.pmod("value.cx", F.lit(4))).alias("part"), "us", "d")
        found = asof_sums(moves, state.withColumn("inclusive", F.lit(False)), ["customer_id", "cy", "cx"], event_us="us", probe_us="us",
                          inclusive="inclusive", sums={f"d{k}": F.when(F.col("part") == k, F.col("d")).otherwise(0).cast("bigint") for k in range(16)})
        parts = F.expr(f"filter(transform(array({', '.join(f'd{k}' for k in range(16))}), (n, k) -> if(n > 0, k, -1)), k -> k >= 0)")
        each = found.select("probe", "customer_id", "lat", "lon", "us", "cy", "cx", F.explode(parts).alias("k"))
        return each.select("probe", "customer_id", "lat", "lon", "us", (F.col("cy") * 4 + F.floor(F.col("k") / 4)).alias("cy"),
                           (F.col("cx") * 4 + F.col("k") % 4).alias("cx"), F.lit(float("inf")).alias("sample_km"))

    # The stretches of the places themselves: from the first visit until it expires.
    spans = own.groupBy("customer_id", "value", "stretch").agg(F.min("us").alias("start"), F.max("us").alias("until"))
    spans = cut(spans.select("customer_id", F.col("value.lat").alias("y"), F.col("value.lon").alias("x"), "start", "until"))
    state, level = _descend(searched, spans, expand)
    met = state.join(spans.select("*", *cell(level, "y", "x")), ["customer_id", "cy", "cx"]).where((F.col("start") < F.col("us")) & (F.col("us") <= F.col("until")))
    far = met.groupBy("probe").agg(F.min(great_circle_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).alias("km"))
    return far.unionByName(here.withColumn("km", F.lit(0.0)))
