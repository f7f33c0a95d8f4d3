"""URL rules by a sort-merge range join on reversed hosts.

A host turns into its labels in reverse ("www.example.com" is
"com.example.www."), so that a host and all its subdomains are one interval of
keys. Rules and distinct hosts are range-partitioned together and sorted; one
sweep per partition keeps the stack of the rules whose interval is open, which
are nested, and gives each host the rules on the stack. An interval may run over
the border of a partition: each partition also reports its first key and the
rules left open at its end (at most one chain of nested hosts, so as many as a
host has labels), and these few rows say which rules reach into which
partitions. A page then meets the rules of its host and takes the longest whose
path begins the page's path.

Defined results. The host is what follows the first "://" up to "/", "?", "#"
or the end, A-Z lower-cased; the path follows up to "?", "#" or the end; a null
url or one without "://" has an empty host and path. A null path of a rule
is empty; rules of null host are left out. Of rules equal in host and path,
"block" wins; of others equally long, the later in the order of strings. Pages without a rule get ``default``.
Each row of ``pages`` gives one row; only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.store import stored
from riskspark.session import importable

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HOST_RULE = "struct<host: string, path: string, verdict: string>"
ARROW_RULE = pa.struct([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])


def lowered(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def split_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row."""
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", lowered(F.regexp_extract(url, PARTS, 1)).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def reversed_key(host: str) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host the rules on the stack; at the end one row (host null) with the open rules and the first key."""
    part, first, stack = TaskContext.get().partitionId(), None, []
    shape = pa.schema([("part", pa.int32()), ("key", pa.string()), ("host", pa.string()), ("rules", pa.list_(ARROW_RULE))])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            key = row["key"]
            first = key if first is None else first
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if row["rule"] is not None:
                stack.append((key, row["rule"]))
            else:
                rows.append({"part": part, "key": key, "host": row["host"], "rules": [r for _, r in stack]})
        yield pa.RecordBatch.from_pylist(rows, shape)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "key": first, "host": None, "rules": [r for _, r in stack]}], shape)


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): all rules whose host is the host or a parent of it."""
    importable(hosts.sparkSession)
    entries = rules.select(reversed_key("host").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"),
                           F.struct("host", "path", "verdict").alias("rule"))
    entries = entries.unionByName(hosts.select(reversed_key("host").alias("key"), F.lit(1).alias("kind"), "host",
                                               F.lit(None).cast(HOST_RULE).alias("rule")))
    swept = stored(entries.repartitionByRange("key").sortWithinPartitions("key", "kind")
                   .mapInArrow(_sweep, f"part int, key string, host string, rules array<{HOST_RULE}>"), "swept")
    # One row per partition, each with at most one chain of nested hosts.
    borders = swept.where("host is null").orderBy("part").collect()
    reach: list = []
    carried = []
    for row in borders:
        reach = [r for r in reach if row.key.startswith(_key(r.host))]
        carried += [(row.part, r.host, r.path, r.verdict) for r in reach]
        reach += row.rules
    found = swept.where("host is not null")
    if not carried:
        return found.select("host", "rules")
    spark = hosts.sparkSession
    carry = spark.createDataFrame(carried, "part int, rule_host string, path string, verdict string")
    carry = carry.select("part", reversed_key("rule_host").alias("rule_key"), F.struct(F.col("rule_host").alias("host"), "path", "verdict").alias("rule"))
    more = (found.select("part", "key", "host").join(carry, "part").where(F.startswith("key", "rule_key"))
            .groupBy("host").agg(F.collect_list("rule").alias("more")))
    return found.join(more, "host", "left").select("host", F.concat("rules", F.coalesce("more", F.array().cast(f"array<{HOST_RULE}>"))).alias("rules"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    ``rules`` has host, path and verdict ("allow" or "block").
    """
    rules = rules.where("host is not null").select(
        lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    parts = split_urls(pages)
    # Stored, so that the join below meets two plain tables and the pages of a large host can be split.
    by_host = stored(rules_by_host(parts.select("host").distinct(), rules), "rules")
    met = parts.join(by_host, "host", "left")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        F.char_length(F.concat(r["host"], r["path"])).alias("n"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return met.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
