"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles. Its sketch has M registers:
register i is floor(1 - log_b x) of the smallest x that a Poisson process of
each element drops on it, cut off at x > 1 (the register is then 0). Registers
of a union are the maxima, and two registers are equal with about the
probability of the Jaccard similarity.

1. Sets are built in one pass; rows with equal sets fall into one class.
2. Bands of R equal registers give buckets. The classes of a bucket are linked
   with one leader each, not with each other, so a bucket of n classes gives
   n - 1 pairs.
3. The likelihood of the joint register comparison, given both set sizes, drops
   pairs that are far below the threshold (by a log likelihood ratio of CUT,
   five standard deviations). The rest is verified on the full sets.
4. Verified links join classes to components. A link that no leader showed can
   only lie between two components that meet in a bucket. All members of
   different components there are compared by their registers, block by block
   inside tasks; only pairs that pass go on to be verified.

With R = 4 and M = 128 a pair at similarity 0.75 shares no band with
probability 5e-6, and one at 0.8 with 5e-8.

Defined results. Words are runs of non-blank characters with A-Z lower-cased. A
row without words has n_shingles 0 and is linked with nothing. Fewer than
``width`` words are one shingle. Each row of the input gives one row. A row
whose id is null takes part; its component is the smallest id reachable, null
if there is none. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as tx
from riskspark.llm.store import stored
from riskspark.plans.fixpoint import connected_components

U = np.uint64
M, R = 128, 4
BANDS = M // R
LOG_B = np.log(1.001)
CUT = 12.5
#: Set elements a block of a bucket holds at most, more or less: the memory of one comparison.
BLOCK_ELEMENTS = 500_000
#: A row is named by two hashes of its id and text.
KEY = ["__k1", "__k2"]


def sketch(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (texts x M, uint16) of the sets ``elements[at[i]:at[i + 1]]``.

    Each element drops points on uniformly chosen registers at exponential
    distances; it is done when its next point lies above every register of its
    text, so long texts need few points per element.
    """
    n = len(at) - 1
    low = np.ones(n * M)
    row = np.repeat(np.arange(n), np.diff(at))
    x = np.zeros(len(elements))
    seed = elements.copy()
    while len(seed):
        seed = tx.mix(seed + tx.GOLD)
        x = x - np.log1p(-((seed >> U(11)).astype(np.float64) * 2.0 ** -53)) / M
        highest = low.reshape(n, M).max(axis=1)
        on = x < highest[row]
        seed, x, row = seed[on], x[on], row[on]
        np.minimum.at(low, row * M + (tx.mix(seed ^ tx.MIX2) % U(M)).astype(np.int64), x)
    k = np.floor(1 - np.log(np.maximum(low, 1e-28)) / LOG_B)
    return np.where(low >= 1, 0, np.clip(k, 0, 65535)).astype(np.uint16).reshape(n, M)


def sets_of(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles, each text's sorted, and borders, piece by piece."""
    for _, data, offsets in tx.pieces(texts):
        data = tx.LOWER[data]
        starts, ends, borders = tx.words(data, offsets, tx.NOT_BLANK)
        runs, at = tx.shingles(tx.word_hashes(data, starts, ends), borders, width)
        sets = [np.unique(runs[at[i]:at[i + 1]]) for i in range(len(at) - 1)]
        yield np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def likelihood_keeps(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Which register pairs (rows of ``a`` and ``b``) leave room for ``threshold``.

    The joint likelihood of more, fewer and equal registers is taken at
    ``threshold`` and at the best of three similarities near its maximum.
    """
    more, fewer = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - fewer
    u = na / (na + nb)
    v = 1 - u
    b_ = np.exp(LOG_B)

    def p(x):
        return -np.log(np.maximum(1 - np.maximum(x, 0) * (b_ - 1) / b_, 1e-300)) / LOG_B

    def log_likelihood(j):
        # Similarity can't exceed the ratio of the sizes.
        j = np.minimum(j, np.minimum(u / v, v / u))
        up, down = p(u - v * j), p(v - u * j)
        return (more * np.log(np.maximum(up, 1e-12)) + fewer * np.log(np.maximum(down, 1e-12))
                + same * np.log(np.maximum(1 - up - down, 1e-12)))

    # The maximum lies near the share of equal registers; missing it slightly only keeps more pairs.
    best = np.maximum.reduce([log_likelihood(np.clip(same / a.shape[1] + d, 0.02, threshold)) for d in (-0.04, 0.0, 0.04)])
    possible = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    return possible & (best - log_likelihood(threshold) <= CUT)


def _int64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for elements, at in sets_of(tx.column(batch, "text"), width):
                n = np.diff(at)
                bands = np.ascontiguousarray(sketch(elements, at)).view(np.int64)
                sums = np.concatenate(([U(0)], np.cumsum(tx.mix(elements ^ tx.MIX1), dtype=np.uint64)))
                node = tx.mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
                rows = batch.slice(first, len(n))
                first += len(n)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2), pa.array(n.astype(np.int64)), _int64(node),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))],
                    ["doc_id", *KEY, "n_shingles", "node", "bands"])
    return run


def _registers(bands: pa.Array) -> np.ndarray:
    flat = bands.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.view(np.uint16).reshape(-1, M)


def _near(threshold: float):
    """(a, b) of the pairs whose registers leave room for the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, ra, rb = batch.columns
            keep = likelihood_keeps(_registers(ra), _registers(rb), na.to_numpy().astype(float), nb.to_numpy().astype(float), threshold)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])
    return run


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for elements, at in sets_of(texts, width):
        for i in range(len(at) - 1):
            yield elements[at[i]:at[i + 1]]


def _verified(width: int, percent: int):
    """(a, b) of the pairs of texts whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_sets(tx.column(batch, "text_a"), width), _sets(tx.column(batch, "text_b"), width)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def _block_links(width: int, percent: int):
    """Links between different components inside one bucket, or between two of its blocks; no more than join them."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, component, block = (group.column(c).to_numpy() for c in ("node", "component", "block"))
        cross = bool((block != block[0]).any())
        size = group.column("n").to_numpy()
        regs = _registers(group.column("bands").combine_chunks() if group.num_rows else group.column("bands"))
        sets = list(_sets(tx.column(group.to_batches()[0], "text"), width))
        vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(size)))
        flags = np.zeros(len(vocabulary), dtype=bool)
        threshold = percent / 100
        component, out = component.copy(), []
        for i in range(len(node) - 1):
            later = np.arange(i + 1, len(node))
            later = later[component[later] != component[i]]
            if cross:
                later = later[block[later] != block[i]]
            # Half of the registers is below the likelihood's own cut for any sizes that allow the threshold.
            later = later[(regs[later] == regs[i]).sum(axis=1) >= M // 2]
            if len(later):
                later = later[likelihood_keeps(np.broadcast_to(regs[i], (len(later), M)), regs[later],
                                               float(size[i]), size[later].astype(float), threshold)]
            if not len(later):
                continue
            flags[ids[at[i]:at[i + 1]]] = True
            for j in later:
                if component[j] == component[i]:
                    continue
                both = int(flags[ids[at[j]:at[j + 1]]].sum())
                if 100 * both >= percent * (size[i] + size[j] - both):
                    out.append((node[i], node[j]))
                    component[component == component[j]] = component[i]
            flags[ids[at[i]:at[i + 1]]] = False
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    return run


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumns({KEY[0]: F.xxhash64("doc_id", "text"), KEY[1]: F.xxhash64(F.lit(7), "text", "doc_id")})


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 75, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``documents``.

    ``kept`` marks the row that bears the smallest id of its component.
    """
    rows = components(documents, width, percent, block)
    component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component_id.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def components(documents: DataFrame, width: int = 5, percent: int = 75, block: int = 512) -> DataFrame:
    """(doc_id, key columns, n_shingles, component, component_id), one row per row of ``documents``.

    ``component`` is a label of the component, null for rows without words;
    ``component_id`` its smallest id.
    """
    docs = _keyed(documents.select("doc_id", "text")).select("doc_id", *KEY, "text")
    id_type = dict(docs.dtypes)["doc_id"]
    rows = stored(docs.transform(tx.in_arrow,
        _sketches(width), f"doc_id {id_type}, {KEY[0]} bigint, {KEY[1]} bigint, n_shingles bigint, node bigint, bands array<bigint>"),
        "sketches")
    classes = stored(rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(*KEY)).alias("row"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    bands = classes.select("node", "n", F.posexplode("bands").alias("pos", "value")).where("value <> 0")
    leaders = bands.groupBy("pos", "value").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members"),
                                                F.sum("n").alias("elements")).where("members > 1")
    met = stored(bands.drop("n").join(leaders, ["pos", "value"]), "met")

    def texts(nodes: DataFrame) -> DataFrame:
        """(node, n, bands, text) of the given classes, each by one row that has the set."""
        wanted = classes.join(nodes.distinct(), "node", "left_semi").select("node", "n", "bands", "row.*")
        found = wanted.join(docs.select(*KEY, "text"), KEY)
        return found.dropDuplicates(["node"]).select("node", "n", "bands", "text")

    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bands").alias(f"r_{s}"))
    pairs = (met.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
             .join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b"))
    pairs = stored(pairs.transform(tx.in_arrow, _near(percent / 100), "a bigint, b bigint"), "pairs")
    found = texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    found = stored(found.select("node", "text"), "texts")
    with_texts = (pairs.join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
                  .join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                  .select("a", "b", "text_a", "text_b"))
    links = stored(with_texts.transform(tx.in_arrow, _verified(width, percent), "a bigint, b bigint"), "links")

    open_buckets = _meeting(met, _components(links))
    spread = (open_buckets.withColumn("blocks", F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("elements") / BLOCK_ELEMENTS)))
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
              .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
              .select("pos", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                      "node", "component", "block"))
    spread = stored(spread, "open")
    more = (spread.join(texts(spread.select("node")), "node").groupBy("pos", "value", "low", "high")
            .applyInArrow(_block_links(width, percent), "a bigint, b bigint"))
    links = links.union(stored(more, "more"))

    component = _components(links)
    labelled = stored(classes.select("node", "least").join(component, "node", "left")
                      .withColumn("component", F.coalesce("component", "node")), "labelled")
    # Stored, so that the join below meets two plain tables and a large component can be split.
    least = stored(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = labelled.join(least, "component").select("node", "component", "component_id")
    return rows.select("doc_id", *KEY, "n_shingles", "node").join(named, "node", "left").drop("node")


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("id").alias("node"), "component")


def _meeting(met: DataFrame, components: DataFrame) -> DataFrame:
    """The buckets where different components still meet; of buckets with the same members, one."""
    labelled = met.join(components, "node", "left").select(
        "pos", "value", "node", "members", "elements", F.coalesce("component", "node").alias("component"))
    buckets = (labelled.groupBy("pos", "value").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.first("members").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"))
        .where("low < high").groupBy("n", "x", "y").agg(F.min(F.struct("pos", "value")).alias("b")).select("b.*"))
    return labelled.join(buckets, ["pos", "value"], "left_semi")


def drop_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component, all columns unchanged.

    It is the row with the smallest id, of rows with that id the one with the
    smallest hash. Rows without words stay, all of them. A component of null ids
    keeps one row too; rows with words that are equal in id and text count as one.
    """
    rows = components(documents, width, percent)
    first = rows.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("row")).select("row.*").select(*KEY)
    keyed = _keyed(documents)
    worded = keyed.join(first, KEY, "left_semi").dropDuplicates(KEY)
    wordless = keyed.join(rows.where("n_shingles = 0").select(*KEY), KEY, "left_semi")
    return worded.union(wordless).select(*documents.columns)
