"""Line dedup by levelled sorted runs of line hashes.

A run is a table (h1, h2, n) sorted by the 128-bit line hash: n documents of
the batches merged into the run hold the line. All runs lie in the same number of
buckets by hash, sorted inside each, so that they meet in merge joins without another
exchange. A new batch is aggregated, its
lines that some run already counts as frequent are taken out by a merge
anti-join, and the rest becomes a run of level 0. When a level has ``fanout``
runs they are merged (a full outer merge join) into one run of the next level, so that a line is
rewritten about log(batches) times. ``buckets`` is how many tasks share a run: take as many as
make a bucket of all distinct lines (24 bytes each) fit a task. A line is frequent when its counts over all
runs reach ``min_docs``; each frequent line leaves every document.

Defined results. A null or empty text is one empty line. The empty key is
never dropped. Every row is a document of its own, repeated rows included. A
document whose lines are all dropped keeps the empty text. Only ``doc_id`` and
``text`` are read, so other columns may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.store import bucketed, stored

#: The characters `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
BUCKETS = 32


def line_keys(text: Column) -> Column:
    """The keys of all lines: A-Z lower-cased, blanks stripped at both ends.

    Text of ASCII characters alone takes the fast built-in; elsewhere it
    would change letters beyond A-Z.
    """
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("h1", F.xxhash64(key)).withColumn("h2", F.xxhash64(F.lit(7), key))


class LineRuns:
    """The levelled runs. ``add`` takes one batch of documents after another."""

    def __init__(self, min_docs: int = 10, min_chars: int = 1, fanout: int = 2, buckets: int = BUCKETS):
        self.min_docs, self.min_chars, self.fanout, self.buckets = min_docs, min_chars, fanout, buckets
        self.levels: list[list[DataFrame]] = []

    def counts(self, docs: DataFrame, *extra: str) -> DataFrame:
        """(h1, h2, n): in how many rows of ``docs`` a key stands, by the columns ``extra``."""
        keys = F.array_distinct(line_keys(F.coalesce("text", F.lit(""))))
        each = docs.select(*extra, F.explode(keys).alias("key")).where(F.char_length("key") >= max(1, self.min_chars))
        return _hashed(each, "key").groupBy(*extra, *HASH).agg(F.count(F.lit(1)).alias("n"))

    def add(self, batch: DataFrame) -> None:
        self.add_counts(self.counts(batch).repartition(self.buckets, *HASH))

    def add_counts(self, counts: DataFrame) -> None:
        self._put(self.fresh(counts), 0)

    def fresh(self, counts: DataFrame) -> DataFrame:
        """The lines that no run counts as frequent yet."""
        for run in self.runs():
            counts = counts.join(run.where(F.col("n") >= self.min_docs).select(*HASH).hint("merge"), HASH, "left_anti")
        return counts

    def _put(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        kept = self.levels[level]
        kept.append(bucketed(run, f"run{level}", HASH, self.buckets))
        if len(kept) == self.fanout:
            self.levels[level] = []
            self._put(merged(kept), level + 1)

    def runs(self) -> list[DataFrame]:
        return [run for level in reversed(self.levels) for run in level]

    def frequent(self) -> DataFrame:
        """The hashes of all frequent lines."""
        return merged(self.runs()).where(F.col("n") >= self.min_docs).select(*HASH)


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of all lines of ``runs`` with their counts added."""
    out = runs[0]
    for run in runs[1:]:
        both = out.join(run.withColumnRenamed("n", "m").hint("merge"), HASH, "full")
        out = both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
    return out


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2,
                   buckets: int = BUCKETS) -> DataFrame:
    """Hashes of the lines in at least ``min_docs`` rows, met in ``batches`` batches.

    The text is read once: line counts of all batches go to one table with a
    folder per batch.
    """
    runs = LineRuns(min_docs, min_chars, fanout, buckets)
    numbered = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    counts = bucketed(runs.counts(numbered, "batch").repartition(buckets, *HASH), "lines", HASH, buckets, "batch")
    for k in range(batches):
        runs.add_counts(counts.where(F.col("batch") == k).drop("batch"))
    return stored(runs.frequent(), "frequent")


def drop_frequent_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4,
                        fanout: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), one row per row of ``documents``.

    Which lines of a document go is found on hashes alone; the text moves once,
    to meet the positions of its dropped lines. A row is named by two hashes of
    its id and text: rows equal in both lose the same lines.
    """
    docs = documents.select("doc_id", "text")
    frequent = frequent_lines(docs, min_docs, min_chars, batches, fanout, buckets)
    text = F.coalesce("text", F.lit(""))
    row = [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("r2")]
    lines = docs.select(*row, F.posexplode(line_keys(text)).alias("pos", "key")).where(F.col("key") != "")
    gone = (_hashed(lines, "key").join(frequent, HASH, "left_semi")
            .groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")))
    whole = docs.select("doc_id", text.alias("text"), *row).join(gone, ["r1", "r2"], "left").select(
        "doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return whole.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("kept_text"))
