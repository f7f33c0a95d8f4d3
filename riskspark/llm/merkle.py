"""Merkle manifest of a data set, its inclusion proofs by octopus multiproofs, and their check.

Every row is a leaf, the sha256 of its five columns. The leaves of a language,
ascending by id, are the lowest level of a tree; runs of ``arity`` nodes become
the hash of their digests, until one node, the subroot, is left. The subroots,
ordered by language, are the leaves of one more tree, whose top is the root.

A leaf partition is a run of ``arity ** height`` consecutive leaves, so its size does
not depend on how many rows a language has. Each partition

1. hashes its leaves upwards and gives its top node, and computes the coordinates
   (tree, level, position) of the nodes that the proofs of all its leaves need and
   that can't be derived from them: the least union, each coordinate once,
2. fetches these nodes by one join with the stored upper levels,
3. derives the inner nodes its leaves share once, and expands the proof of each
   leaf from them and the fetched nodes, without reading anything else.

The upper levels are built the same way, a partition of top nodes at a time, and
hold about 2 / arity ** height nodes a leaf. Positions come from a range partitioning
and the row counts of its parts; no window or task holds a whole language.

Defined results. A null column hashes as ``-``. Rows of null id come first; rows of
equal id are ordered by their leaf; rows equal in both can change places without any effect
but on which of them gets which proof, and each is a leaf of its own. A null language is a
language, the first. A table without rows has no leaves and gives no rows. Only
the five columns named in ``FIELDS`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.store import stored
from riskspark.session import importable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number that stands for the tree over the subroots.
TOP = -1
FOUND = "owner bigint, part bigint, tree bigint, size bigint, level int, idx bigint, hash string, top boolean"
STEP = [pa.field("left", pa.string()), pa.field("right", pa.string())]
PROOF = "proof array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the byte count of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the position within its group (from 0), and ``size``, the group's rows.

    Stored in parts by range; the counts of (part, group) give the offsets. Equal
    rows are spread over parts as well. Few rows, one per part and group, meet in a window.
    """
    keys = [*group, *order, "__tie"]
    parts = stored(rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .drop("__tie").withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = parts.groupBy(part.alias("__part"), *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    same = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        "__part", *[F.col(g).alias(f"__{g}") for g in group], "__first", F.sum("__n").over(same).alias("size"),
        (F.sum("__n").over(same.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    match = part == F.col("__part")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return parts.join(offsets, match).select(
        *rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("idx"), "size")


def digest(texts: Sequence[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def sizes(size: int, arity: int) -> list[int]:
    """How many nodes the levels of a tree of ``size`` leaves have, up to the top."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def climb(hashes: list[str], levels: int, arity: int) -> list[list[str]]:
    """The nodes of consecutive leaves and of ``levels`` levels above them."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[i:i + arity]) for i in range(0, len(below), arity)])
    return out


def missing(held: np.ndarray, counts: list[int], arity: int) -> list[tuple[int, int]]:
    """Octopus: the least set of (level, position) from which, together with the nodes ``held``
    of the lowest level, the proofs of all of them follow."""
    out = []
    for level, count in enumerate(counts[:-1]):
        above = np.unique(held // arity)
        runs = (above[:, None] * arity + np.arange(arity)).ravel()
        runs = runs[runs < count]
        out += [(level, int(i)) for i in runs[~np.isin(runs, held)]]
        held = above
    return out


def in_order(group: pa.Table) -> tuple[np.ndarray, pa.Table]:
    idx = group.column("idx").to_numpy()
    order = np.argsort(idx, kind="stable")
    return idx[order], group.take(pa.array(order)).combine_chunks()


def _hash_up(arity: int, height: int, base: int, n_trees: int | None):
    """One partition of nodes of level ``base``: the nodes above them. For leaves (``n_trees`` is given) the
    top node alone, and the coordinates the partition lacks, with a null hash."""
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        idx, group = in_order(group)
        tree, part = (k.as_py() for k in key)
        size, first = group.column("size")[0].as_py(), int(idx[0])
        counts = sizes(size, arity)
        levels = min(height, len(counts) - 1 - base)
        nodes = climb(group.column("hash").to_pylist(), levels, arity)
        lowest = levels if n_trees is not None else 1
        out = [(tree, part, tree, size, base + k, first // arity ** k + i, h, counts[base + k] == 1)
               for k in range(lowest, levels + 1) for i, h in enumerate(nodes[k])]
        if n_trees is not None:
            out += [(tree, part, tree, size, level, i, None, False) for level, i in missing(idx, counts, arity)]
            out += [(tree, part, TOP, n_trees, level, i, None, False) for level, i in missing(np.array([tree]), sizes(n_trees, arity), arity)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        names = ("owner", "part", "tree", "size", "level", "idx", "hash", "top")
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, list(zip(*out)) or [()] * 8, kinds)})
    return run


def parted(nodes: DataFrame, width: int):
    return nodes.groupBy("tree", F.floor(F.col("idx") / width).alias("part"))


def upper_levels(nodes: DataFrame, arity: int, height: int, base: int, largest: int, name: str) -> DataFrame | None:
    """All nodes above level ``base`` of the trees whose nodes of that level are given; the largest has ``largest`` leaves."""
    out, left = None, len(sizes(largest, arity)) - 1 - base
    while left > 0:
        made = stored(parted(nodes.select("tree", "size", "idx", "hash"), arity ** height)
                      .applyInArrow(_hash_up(arity, height, base, None), FOUND), f"{name}-{base}")
        out = made if out is None else out.unionByName(made)
        base, left = base + height, left - height
        nodes = made.where((F.col("level") == base) & ~F.col("top"))
    return out


def _expand(arity: int, n_trees: int):
    """The proofs of one partition's leaves from the leaves and the fetched nodes."""
    def run(key: tuple[pa.Scalar, ...], leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        idx, leaves = in_order(leaves)
        tree = key[0].as_py()
        have = {(t, level, i): h for t, level, i, h in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "hash")))}
        texts, lefts, rights = [""], [], []

        def ascend(t: int, held: np.ndarray, hashes: list[str], counts: list[int], at: np.ndarray) -> str:
            """Up one tree: per level, what stands left and right of each held node in its run. ``at``: each leaf's node."""
            for level, count in enumerate(counts[:-1]):
                node = dict(zip(held.tolist(), hashes))
                place, above, hashes = {}, np.unique(held // arity), []
                for up in above.tolist():
                    members = range(up * arity, min((up + 1) * arity, count))
                    values = [node[i] if i in node else have[t, level, i] for i in members]
                    hashes.append(digest(values))
                    for j, i in enumerate(members):
                        if i in node:
                            place[i] = len(texts)
                            texts.extend(("".join(values[:j]), "".join(values[j + 1:])))
                where = np.array([place[i] for i in held.tolist()])[np.searchsorted(held, at)]
                lefts.append(where)
                rights.append(where + 1)
                held, at = above, at // arity
            return hashes[0]

        size = leaves.column("size")[0].as_py()
        subroot = ascend(tree, idx, leaves.column("hash").to_pylist(), sizes(size, arity), idx)
        root = ascend(TOP, np.array([tree]), [subroot], sizes(n_trees, arity), np.full(len(idx), tree))
        words, steps = pa.array(texts), len(lefts)
        sides = [words.take(pa.array(np.stack(s, axis=1).ravel())) if steps else pa.array([], pa.string()) for s in (lefts, rights)]
        proof = pa.ListArray.from_arrays(pa.array(np.arange(len(idx) + 1) * steps, pa.int32()),
                                         pa.StructArray.from_arrays(sides, fields=STEP))
        out = leaves.drop_columns(["idx", "size", "tree"])
        return (out.append_column("subroot", pa.array([subroot] * len(idx))).append_column("root", pa.array([root] * len(idx)))
                .append_column("proof", proof))
    return run


class Manifest:
    """The stored leaves and upper nodes of ``docs``. ``carry``: further columns of the leaves, computed from the row."""

    def __init__(self, docs: DataFrame, arity: int = 2, height: int = 12, carry: Sequence[Column] = ()):
        if arity < 2 or height < 1:
            raise ValueError("a run has two nodes at least, and a partition one level")
        importable(docs.sparkSession)
        self.arity, self.height = arity, height
        own = docs.select("doc_id", "lang", leaf_hash([F.col(c) for c in FIELDS]).alias("hash"), *carry)
        # Hashed once: the sampling of the ranges would otherwise read all texts twice.
        leaves = numbered(stored(own, "leaves"), ["lang"], ["doc_id", "hash"], "ordered-leaves")
        langs = stored(leaves.groupBy("lang").agg(F.max("size").alias("n")), "langs")
        trees = numbered(langs, [], ["lang"], "ordered-langs").select(F.col("lang").alias("__lang"), F.col("idx").alias("tree"), "n")
        self.leaves = stored(leaves.join(trees, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang", "n"), "leaves-by-tree")
        self.n_trees, largest = langs.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
        first = stored(parted(self.leaves.select("tree", "size", "idx", "hash"), arity ** height)
                       .applyInArrow(_hash_up(arity, height, 0, self.n_trees), FOUND), "tops")
        self.wanted = first.where("hash is null").select("owner", "part", "tree", "level", "idx")
        tops = first.where("hash is not null")
        more = upper_levels(tops.where(~F.col("top")), arity, height, height, largest, "upper")
        lower = tops if more is None else tops.unionByName(more)
        subroots = lower.where("top").select(
            F.lit(TOP).cast("bigint").alias("tree"), F.lit(self.n_trees).cast("bigint").alias("size"), F.lit(0).alias("level"),
            F.col("tree").alias("idx"), "hash", F.lit(self.n_trees == 1).alias("top"))
        above = upper_levels(subroots, arity, height, 0, self.n_trees, "top")
        shape = ["tree", "level", "idx", "hash", "top"]
        self.nodes = lower.select(shape).unionByName(subroots.select(shape))
        if above is not None:
            self.nodes = self.nodes.unionByName(above.select(shape))

    def proofs(self) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and ``proof``: level by level up to the root, what stands left and right
        of the node in its run ('' where nothing does)."""
        fetched = self.wanted.join(self.nodes, ["tree", "level", "idx"]).select("owner", "part", "tree", "level", "idx", "hash")
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.leaves.schema if f.name not in ("idx", "size", "tree")]
        return (parted(self.leaves, self.arity ** self.height).cogroup(fetched.groupBy("owner", "part"))
                .applyInArrow(_expand(self.arity, self.n_trees), ", ".join([*kinds, "subroot string, root string", PROOF])))

    def root(self) -> str | None:
        """The hash over everything; none for a table without rows."""
        top = self.nodes.where((F.col("tree") == TOP) & F.col("top")).first()
        return top and top["hash"]


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """The siblings of a proof in one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def audit(docs: DataFrame, arity: int = 2, height: int = 12) -> DataFrame:
    """Every row's proof, checked against its leaf; where 7 divides the crc32 of the id, against the leaf of a
    row whose ``n_chars`` is one more (null stays, and the greatest whole number becomes null)."""
    one_more = [F.try_add(F.col(c), F.lit(1).cast("bigint")) if c == "n_chars" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = F.when(chosen & F.col("n_chars").isNotNull(), leaf_hash(one_more)).alias("tampered")
    proofs = Manifest(docs, arity, height, [tampered]).proofs()
    checked = proofs.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                            folded(F.coalesce("tampered", "hash"), F.col("proof")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
