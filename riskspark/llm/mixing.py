"""Mixing sources to target weights by Pfair scheduling.

Target shares become whole numbers w that add up to a period R, by largest remainder. Shares that
follow from the sizes have a period of ``resolution`` slots, or of as many as the smallest share
needs to get a slot, up to ``max_period``; weights that are given have ``resolution`` slots. A share that
would round to no slot even then gets one. Block i (from 0)
of a source has release time floor(i * R / w) and deadline ceil((i + 1) * R / w).
Slot after slot, the released block with the earliest deadline is taken; since the
weights fill the period exactly, every block meets its window, and each source is less
than one block away from its share w / R after every slot. The schedule repeats after R
slots, so block i has the closed-form position (i div w) * R + slot[i mod w].

One period is ordered by a heap of released blocks, in time R * log(sources). The list
of sources with their sizes and the slots of one period are all the driver sees; their number
is that of the sources and ``max_period``, whatever the number of documents, and so
the table of slots that is broadcast has a proven bound of 8 bytes a slot.

A block is one document. The documents of a source come in the order of a
hash. The mix ends at the first slot where every document has been placed, so
none is lost; sources that are small against their weight start over (epochs)
and their documents repeat. ``repeats`` tells how often before anything is written, and
``max_epochs`` ends the mix where a source would start over once more; larger
sources are then not placed as a whole.

Defined results. A null source is a source of its own. Null ids are ordered
like empty ones; rows with equal ids are ordered by a hash of their text, equal
rows in any order. A given weight of 0 leaves its source out, and a source that is not listed
among the given ones gets one slot. Only ``doc_id``, ``source`` and
``text`` are read by ``mix``; ``interleave`` keeps every column. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.store import stored

#: Names for helper columns, meant not to meet any column of the input.
S, RANK, AT, POSITION, EPOCH = "__source", "__rank", "__bucket", "__position", "__epoch"
#: Most slots of a period.
MAX_PERIOD = 1 << 18
PLAN = f"array<struct<{S}:string,n:bigint,w:bigint,period:bigint,slots:array<bigint>,blocks:bigint,share:double>>"


def _tag(name: str | None) -> str:
    return "0" if name is None else f"1{name}"


def whole_weights(shares: list[float], period: int) -> list[int]:
    """Whole numbers in proportion to ``shares`` (adding up to 1), by largest remainder over the whole
    period. None is 0: those that would be take a slot each, and if these are too many the period is longer."""
    exact = [round(s * period, 9) for s in shares]
    out = [max(1, math.floor(x)) for x in exact]
    rest = [round(x - math.floor(x), 9) if x >= 1 else 0.0 for x in exact]
    for k in sorted(range(len(shares)), key=lambda k: (-rest[k], k))[:max(0, period - sum(out))]:
        out[k] += 1
    return out


def earliest_deadline_first(weights: list[int]) -> list[list[int]]:
    """Per source the slots of its blocks in one period."""
    period = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting, released = [(0, k) for k in range(len(weights))], []
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(released, (-(-(len(slots[k]) + 1) * period // weights[k]), k))
        k = heapq.heappop(released)[1]
        slots[k].append(t)
        if len(slots[k]) < weights[k]:
            heapq.heappush(waiting, (len(slots[k]) * period // weights[k], k))
    return slots


def schedule(sizes: DataFrame, alpha: float, resolution: int, weights: dict | None, max_period: int = MAX_PERIOD,
             max_epochs: int | None = None) -> DataFrame:
    """(source, n, w, period, slots, blocks, share): per source its slots in a period and its number of blocks in the mix."""
    given = None if weights is None else {_tag(k): float(v) for k, v in weights.items()}
    # One row per source.
    rows = sorted((r[S], r["n"]) for r in sizes.select(S, "n").collect())
    if given is not None:
        rows = [r for r in rows if given.get(r[0], 1.0) > 0]
        wanted = [given.get(s, 0.0) for s, _ in rows]
    else:
        wanted = [float(n) ** alpha for _, n in rows]
    plan = []
    if rows:
        total = math.fsum(wanted)
        shares = [x / total for x in wanted] if total > 0 else [1 / len(rows)] * len(rows)
        needed = 0 if given is not None else min(max_period, math.ceil(round(1 / min(shares), 6)))
        w = whole_weights(shares, max(resolution, needed))
        slots, period = earliest_deadline_first(w), sum(w)
        ends = [(n - 1) // w[k] * period + slots[k][(n - 1) % w[k]] + 1 for k, (_, n) in enumerate(rows)]
        length = max(ends)
        if max_epochs is not None:
            again = [max_epochs * n for _, n in rows]
            length = min(length, min(again[k] // w[k] * period + slots[k][again[k] % w[k]] for k in range(len(rows))))
        plan = [{S: s, "n": n, "w": w[k], "period": period, "slots": slots[k], "share": shares[k],
                 "blocks": length // period * w[k] + bisect_left(slots[k], length % period)} for k, (s, n) in enumerate(rows)]
    text = F.from_json(F.lit(json.dumps(plan)), PLAN)
    return stored(sizes.sparkSession.range(1).select(F.explode(text).alias("p")).select("p.*"), "schedule")


def period_weights(sizes: DataFrame, alpha: float = 0.7, resolution: int = 1000, weights: dict | None = None) -> DataFrame:
    """One row (period, sources): an array of (name, n, w), the weights adding up to the period."""
    one = F.struct(F.col(S).alias("name"), "n", "w")
    return schedule(sizes, alpha, resolution, weights).agg(F.max("period").alias("period"), F.sort_array(F.collect_list(one)).alias("sources"))


def repeats(documents: DataFrame, alpha: float = 0.7, resolution: int = 1000, weights: dict | None = None,
            max_epochs: int | None = None) -> DataFrame:
    """(source, documents, target_share, scheduled_share, placed, epochs): how often ``mix`` will place the documents of each source."""
    sizes = _ordered(documents.select("doc_id", "source", "text")).groupBy(S).agg(F.count(F.lit(1)).alias("n"))
    plan = schedule(sizes, alpha, resolution, weights, MAX_PERIOD, max_epochs)
    return plan.select(F.when(F.col(S) != "0", F.substr(S, F.lit(2))).alias("source"), F.col("n").alias("documents"),
                       F.col("share").alias("target_share"), (F.col("w") / F.col("period")).alias("scheduled_share"),
                       F.col("blocks").alias("placed"), (F.col("blocks") / F.col("n")).alias("epochs"))


def _placed(rows: DataFrame, sizes_of: DataFrame, alpha: float, resolution: int, weights: dict | None,
            max_epochs: int | None) -> DataFrame:
    """``rows`` with their positions: __source, __order (hash order) and anything else are kept."""
    counts = stored(sizes_of.groupBy(S, AT).agg(F.count(F.lit(1)).alias("m")), "buckets")
    before = Window.partitionBy(S).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(S, AT, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("__before"))
    plan = schedule(counts.groupBy(S).agg(F.sum("m").alias("n")), alpha, resolution, weights, MAX_PERIOD, max_epochs)
    inside = Window.partitionBy(S, AT).orderBy("__order")
    ranked = rows.withColumn(RANK, F.row_number().over(inside) - 1)
    # The rows lie by (source, bucket) already, so a merge join moves the small side alone.
    ranked = ranked.join(offsets.hint("merge"), [S, AT]).withColumn(RANK, F.col(RANK) + F.col("__before")).drop("__before")
    # At most max_period slots in all.
    plan = F.broadcast(plan.select(S, F.struct("n", "w", "period", "slots", "blocks").alias("__plan")))
    out = ranked.join(plan, S).where(F.expr(f"{RANK} < __plan.blocks")).withColumn(
        EPOCH, F.explode(F.expr(f"sequence(0L, (__plan.blocks - 1 - {RANK}) div __plan.n)")))
    i = f"({RANK} + {EPOCH} * __plan.n)"
    return out.withColumn(POSITION, F.expr(
        f"({i} div __plan.w) * __plan.period + __plan.slots[cast({i} % __plan.w as int)]"))


def _ordered(documents: DataFrame) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    name = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return (documents.withColumn("__order", F.struct(digest.alias("d"), F.xxhash64("text").alias("t")))
            .withColumn(AT, F.substring(digest, 1, 3)).withColumn(S, name))


def mix(documents: DataFrame, alpha: float = 0.7, resolution: int = 1000, weights: dict | None = None,
        max_epochs: int | None = None) -> DataFrame:
    """(doc_id, source, epoch, position): the order of the mixed corpus, one row per placed document."""
    rows = _ordered(documents.select("doc_id", "source", "text")).drop("text")
    return _placed(rows, rows.select(S, AT), alpha, resolution, weights, max_epochs).select(
        "doc_id", "source", F.col(EPOCH).alias("epoch"), F.col(POSITION).alias("position"))


def interleave(documents: DataFrame, alpha: float = 0.7, resolution: int = 1000, weights: dict | None = None,
               rows_per_part: int = 2_048, max_epochs: int | None = None) -> DataFrame:
    """The mixed corpus itself with all columns of ``documents``, dealt out by consecutive
    stretches of the mix; a part holds one or more stretches, each in its order."""
    names = documents.columns
    rows = _ordered(documents)
    placed = _placed(rows, rows.select(S, AT), alpha, resolution, weights, max_epochs)
    return (placed.withColumn("__part", (F.col(POSITION) / rows_per_part).cast("int"))
            .repartition("__part").sortWithinPartitions(POSITION).select(*names))
