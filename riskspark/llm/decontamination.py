"""Benchmark decontamination by a generalised suffix automaton.

The words of all benchmark items go into one automaton per block of items, so
its size is bounded by ``block_words`` whatever the benchmark holds; every
block is one pass over the documents. A document's words are streamed through
the automaton, which gives at every word the longest match that ends there; a
window is found where the match is as long as the window and the state (or an
ancestor by suffix links) is marked with it. Words are streamed only where
runs of short grams of the benchmark make a window possible; that test is a bit
table over gram hashes and never loses a window.

Defined results. Words are runs of digits, a-z and characters beyond ASCII,
after A-Z are lower-cased. An item of fewer than ``window`` words is one window;
an item without words has none. A null text has no words. Items of null id mark
words but are not counted or listed; repeated item ids count once. Each row of
``documents`` gives one row. Only ``doc_id``, ``text``, ``item_id`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from riskspark.llm import text as tx
from riskspark.llm.store import stored

GRAM = 5
TABLE_BITS = 24


class Automaton:
    """Suffix automaton of several word sequences, with windows marked at states."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: state -> [(window length, ids of its items)]; the nearest state by links that has any.
        self.windows: dict[int, list[tuple[int, set]]] = {}
        self.marked: list[int] = []

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state ``q`` for the matches that end through ``p``."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)

    def mark(self, words: list[int], item, window: int) -> None:
        """Mark all windows of an item; call when all items have been added."""
        size, v = min(window, len(words)), 0
        for i, c in enumerate(words):
            v = self.next[v][c]
            if i + 1 >= size:
                while self.length[self.link[v]] >= size:
                    v = self.link[v]
                have = self.windows.setdefault(v, [])
                ids = next((ids for w, ids in have if w == size), None)
                if ids is None:
                    have.append((size, ids := set()))
                if item is not None:
                    ids.add(item)

    def finish(self) -> None:
        self.marked = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[v] = v if v in self.windows else self.marked[self.link[v]]

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set]]:
        """(end, length, ids) of all windows in ``words``."""
        v = matched = 0
        for i, c in enumerate(words):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            u = self.marked[v]
            while u:
                for size, ids in self.windows[u]:
                    if size <= matched:
                        yield i + 1, size, ids
                u = self.marked[self.link[u]]


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, data, offsets in tx.pieces(pa.array(texts, pa.large_string()).fill_null("")):
        data = tx.LOWER[data]
        starts, ends, borders = tx.words(data, offsets, tx.ALNUM)
        h = tx.word_hashes(data, starts, ends)
        out += [h[borders[i]:borders[i + 1]] for i in range(len(borders) - 1)]
    return out


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each position on (across texts, which only adds candidates)."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * tx.BASE + hashes[j:len(hashes) - size + 1 + j]
    return tx.mix(out) >> np.uint64(64 - TABLE_BITS)


class Matcher:
    """An automaton, its shortest window and the table of its grams."""

    def __init__(self, items: list[tuple], window: int):
        self.automaton = Automaton()
        hashed = [(item, h) for (item, _), h in zip(items, item_words([t for _, t in items])) if len(h)]
        for _, h in hashed:
            self.automaton.add(h.tolist())
        for item, h in hashed:
            self.automaton.mark(h.tolist(), item, window)
        self.automaton.finish()
        self.shortest = min((min(window, len(h)) for _, h in hashed), default=0)
        self.gram = min(GRAM, self.shortest)
        bits = np.zeros(1 << TABLE_BITS, dtype=bool)
        for _, h in hashed:
            bits[grams(h, self.gram)] = True
        self.bits = np.packbits(bits)

    def find(self, hashes: np.ndarray, borders: np.ndarray, bits: np.ndarray) -> dict[int, tuple[np.ndarray, set, int]]:
        """By text: its hit words, the ids of items found and the longest match of a window."""
        found: dict[int, tuple[np.ndarray, set, int]] = {}
        if not self.shortest:
            return found
        starts, ends = tx.contiguous_runs(bits[grams(hashes, self.gram)])
        long = ends - starts >= self.shortest - self.gram + 1
        for s, e in zip(starts[long], ends[long] + self.gram - 1):
            first, last = np.searchsorted(borders, (s, e - 1), side="right") - 1
            for row in range(first, last + 1):
                low, high = max(s, borders[row]), min(e, borders[row + 1])
                if high - low < self.shortest:
                    continue
                for end, size, ids in self.automaton.stream(hashes[low:high].tolist()):
                    if row not in found:
                        found[row] = (np.zeros(borders[row + 1] - borders[row], dtype=bool), set(), 0)
                    hit, items, longest = found[row]
                    at = low - borders[row] + end
                    hit[at - size:at] = True
                    items |= ids
                    found[row] = (hit, items, max(longest, size))
        return found


RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _found(matcher, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        bits = np.unpackbits(m.bits).view(bool)
        for batch in batches:
            for row, data, offsets in tx.pieces(tx.column(batch, "text")):
                lowered = tx.LOWER[data]
                starts, ends, borders = tx.words(lowered, offsets, tx.ALNUM)
                found = m.find(tx.word_hashes(lowered, starts, ends), borders, bits)
                runs, items = [], []
                for i in range(len(offsets) - 1):
                    hit, ids, _ = found.get(i, (None, (), 0))
                    spans = []
                    if hit is not None:
                        body = data[offsets[i]:offsets[i + 1]].tobytes()
                        chars = lambda b, base=offsets[i]: len(body[:b - base].decode())  # noqa: E731, B023
                        for s, e in zip(*tx.contiguous_runs(hit)):
                            spans.append({"first": s, "last": e, "start": chars(starts[borders[i] + s]),
                                          "end": chars(ends[borders[i] + e - 1])})
                    runs.append(spans)
                    items.append(list(ids))
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(borders).astype(np.int64)),
                     pa.array(runs, pa.list_(RUN)), pa.array(items, pa.list_(item_type))],
                    ["doc_id", "t", "n_words", "runs", "items"])
    return run


#: Overlapping or touching runs of several passes become one, in words and in characters.
MERGED = """aggregate(array_sort(runs), cast(array() as array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>),
  (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).last >= x.first,
    concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first,
      'last', greatest(element_at(acc, -1).last, x.last), 'start', element_at(acc, -1).start,
      'end', greatest(element_at(acc, -1).end, x.end)))),
    concat(acc, array(x))))"""


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> DataFrame:
    """(item_id, text, block): items in blocks of about ``block_words`` words by their length."""
    items = stored(benchmark.select("item_id", "text").where("text is not null").distinct().withColumn("w", F.length("text") / 2 + 1), "all-items")
    words = items.agg(F.sum("w")).first()[0] or 0
    # Many slots to a block, however many words there are.
    items = items.withColumn("slot", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1024, int(32 * words / block_words)))))
    slots = items.groupBy("slot").agg(F.sum("w").alias("w"))
    upto = slots.withColumn("block", (F.sum("w").over(Window.orderBy("slot")) / block_words).cast("int")).select("slot", "block")
    return stored(items.join(upto, "slot").select("item_id", "text", "block"), "items")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20,
                  block_words: int = 200_000) -> DataFrame:
    """(doc_id, t, n_words, n_hit, items, runs, contaminated), one row per row of ``documents``.

    ``t`` is the 64-bit hash of the text; ``runs`` are the stretches of hit words, in words
    and in characters. A document is contaminated when its hit words are at least one in ``coverage``.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.xxhash64("text").alias("t"), "text")
    kinds = dict(docs.dtypes) | dict(benchmark.select("item_id").dtypes)
    schema = (f"doc_id {kinds['doc_id']}, t bigint, n_words bigint, "
              f"runs array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>, items array<{kinds['item_id']}>")
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    blocks = benchmark_blocks(benchmark, block_words)
    passes = []
    for (block,) in blocks.select("block").distinct().orderBy("block").collect() or [(0,)]:
        # At most about block_words words come to the driver at a time.
        items = [(r.item_id, r.text) for r in blocks.where(F.col("block") == block).collect()]
        matcher = spark.sparkContext.broadcast(Matcher(items, window))
        passes.append(stored(docs.transform(tx.in_arrow, _found(matcher, item_type), schema), f"pass{block}"))
        matcher.unpersist()
    hits = passes[0].where("size(runs) > 0")
    for p in passes[1:]:
        hits = hits.unionByName(p.where("size(runs) > 0"))
    hits = hits.groupBy("doc_id", "t").agg(
        F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).withColumn("runs", F.expr(MERGED))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "runs", "items",
                       F.expr("aggregate(runs, 0L, (n, x) -> n + x.last - x.first)").alias("n_hit"))
    rows = passes[0].select("doc_id", "t", "n_words")
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("t").eqNullSafe(F.col("u")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "t", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast(f"array<{kinds['item_id']}>")).alias("items"),
        "runs", ((n_hit > 0) & (n_hit * coverage >= F.col("n_words"))).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and the hash of the item ids."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, all columns unchanged."""
    bad = contamination(documents, benchmark, **options).where("contaminated").select(
        F.col("doc_id").alias("__d"), F.col("t").alias("__t")).distinct()
    same = documents["doc_id"].eqNullSafe(F.col("__d")) & F.xxhash64(documents["text"]).eqNullSafe(F.col("__t"))
    return documents.join(bad, same, "left_anti")


def cut_spans(documents: DataFrame, benchmark: DataFrame, min_words: int = 13, **options) -> DataFrame:
    """The documents with every stretch of at least ``min_words`` hit words taken out of the
    text; contaminated documents go as a whole."""
    found = contamination(documents, benchmark, **options)
    bad = found.where(F.col("n_hit") > 0).select(
        F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("contaminated").alias("__bad"),
        F.filter("runs", lambda x: x["last"] - x["first"] >= min_words).alias("__runs")).distinct()
    same = documents["doc_id"].eqNullSafe(F.col("__d")) & F.xxhash64(documents["text"]).eqNullSafe(F.col("__t"))
    rest = F.expr("""concat(array_join(transform(__runs, (x, i) -> substring(text,
        cast(if(i = 0, 0, __runs[i - 1].end) + 1 as int), cast(x.start - if(i = 0, 0, __runs[i - 1].end) as int))), ''),
        substring(text, cast(element_at(__runs, -1).end + 1 as int)))""")
    joined = documents.join(bad, same, "left").where("coalesce(not __bad, true)")
    return joined.withColumn("text", F.when(F.size("__runs") > 0, rest).otherwise(F.col("text"))).select(*documents.columns)
