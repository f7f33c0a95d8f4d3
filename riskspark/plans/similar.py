"""Similar texts without comparing all of them: rare pairs of letters as meeting points.

The similarity of two texts may be any ratio r that leaves a common subsequence
of M letters with 2 * M >= r * S, S being the sum of their lengths: matched
blocks (2 * M / S) and edits (1 - edits / longer length) both do. Such a
subsequence falls into at most S - 2 * M + 1 stretches, so the texts, each with a
mark at both ends, share at least S * (1.5 * r - 1) + 1 pairs of neighbouring
letters. With the pairs of letters in one common order, rare ones first, texts of
that similarity meet already among the first few (prefix filter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of ratios are met by sums of floating-point numbers.
SLACK = 1e-9


def letters(text: Column, width: int = 1) -> Column:
    """All stretches of ``width`` letters, in order."""
    n = F.char_length(text) - (width - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(width)))).otherwise(
        F.array().cast("array<string>"))


def rare_first(rows: DataFrame, by: list[str], text: str, into: str) -> DataFrame:
    """``rows``, whose columns ``by`` name a row, with the distinct pairs of letters of
    ``text`` as ``into``, rare ones first; the k-th occurrence of a pair is a pair of its own."""
    marked = F.concat(F.lit("\x02"), F.col(text), F.lit("\x03"))
    pairs = (rows.select(*by, F.explode(letters(marked, 2)).alias("pair")).groupBy(*by, "pair").agg(F.count(F.lit(1)).alias("n"))
             .select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat("pair", k.cast("string")))).alias("pair")))
    known = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"))
    ordered = pairs.join(known, "pair").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rows", "pair"))).alias(into))
    return rows.join(ordered.withColumn(into, F.col(into)["pair"]), by)


def least_shared(total: Column, ratio: float | Column) -> Column:
    """Pairs of letters that two texts of ``total`` letters share at least at this similarity."""
    return F.ceil(total * (F.lit(1.5) * ratio - 1) + 1 - SLACK)


def least_length(length: Column, ratio: float | Column) -> Column:
    """Length that a text of this similarity has at least."""
    return F.ceil(length * F.lit(ratio) / (2 - F.lit(ratio)) - SLACK)


def meeting_points(ordered: Column, length: Column, ratio: float, shared: int = 1) -> Column:
    """The first entries of ``ordered``, of which texts of this similarity have ``shared`` in common."""
    common = least_shared(length + least_length(length, ratio), ratio)
    return F.slice(ordered, F.lit(1), F.greatest(length + 1 - common + shared, F.lit(0)).cast("int"))


def two_of(points: Column) -> Column:
    """All unordered choices of two entries."""
    return F.flatten(F.transform(points, lambda x, i: F.transform(
        F.slice(points, i + 2, F.size(points)), lambda y: F.concat(x, F.lit("\x04"), y))))


def without_one(text: Column) -> Column:
    """The text without each of its letters in turn: equal for texts that one letter sets apart."""
    n = F.char_length(text)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(
        F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n))))).otherwise(F.array().cast("array<string>"))


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts is above that of the letters they have in common, in any order."""
    total = F.char_length(a) + F.char_length(b)

    def times(text: Column, letter: Column) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, letter, F.lit("")))

    common = F.aggregate(F.array_distinct(letters(a)), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    return F.when(total > 0, 2 * common / total).otherwise(1.0)
