"""Product quantisation in whole numbers, with the nearest entry looked up by memoised grid cells.

Vectors are cut into ``parts`` equal parts, and every part position has a codebook of up to
``entries`` entries. It starts with the parts of the first rows and moves each entry
to the mean of the parts it is nearest to, ``rounds`` times.

Nearest entries. A part falls into a cell of a coarse grid, ``cell`` units wide in
each dimension. The least and the greatest distance of an entry from the cell's box
are sums over dimensions of numbers that depend on the dimension and the grid line
alone, so they come from one small table per dimension. An entry whose least
distance exceeds another entry's greatest one is dominated in the whole box. The
entries that are left are kept per cell for the task, up to ``MEMO`` cells of a
part at a time, and only they are compared with the part exactly. The width of the cells
changes the work and never the result.

A round is one pass over the stored vectors. Every task gives the sums of its own parts by
entry, at most parts * entries * (width + 1) numbers; Spark adds them up and the driver
gets one codebook, whose size does not depend on the rows.

Defined results. Rows whose vector is null or holds a null or a component that is not
finite are dropped; rows of null id or label stay. Components become floor(scale * x),
at most 2^26 in size, so that distances are whole numbers without overflow.
Vectors shorter than the longest, or than the next multiple of ``parts``, count as
followed by zeros. The first rows are those of the smallest ids (null last), equal
ids by their components; equal rows are rows of their own. With fewer rows than
``entries`` the codebooks are shorter. Ties go to the lower entry. No rows give no rows.
Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.store import stored
from riskspark.session import importable

#: Largest size of a component; cells a task remembers for a part; pairs compared at once.
MOST, MEMO, TOGETHER = 1 << 26, 1 << 16, 1 << 17


def whole_numbers(vectors: DataFrame, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, all of one length, and the length of a part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    whole = F.transform("x", lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    kept = stored(vectors.where("embedding is not null").select("vec_id", "label", x.alias("x")).where(sound)
                  .select("vec_id", "label", whole.alias("v")), "whole")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    padding = F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("v"))
    return kept.withColumn("v", F.concat("v", padding)), width


class Codebook:
    """Nearest entries of one part position."""

    def __init__(self, entries: np.ndarray, cell: int):
        self.entries, self.cell = entries, cell
        self.memo: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> Iterator[np.ndarray]:
        """For each cell, given by its grid lines, the entries that some place in its box may be nearest to."""
        n = len(self.entries)
        least, most = np.zeros((len(cells), n), np.int64), np.zeros((len(cells), n), np.int64)
        for d in range(cells.shape[1]):
            lines, at = np.unique(cells[:, d], return_inverse=True)
            low = lines[:, None] * self.cell
            high, entry = low + self.cell - 1, self.entries[:, d][None, :]
            near = np.maximum(np.maximum(low - entry, entry - high), 0)
            far = np.maximum(np.abs(entry - low), np.abs(entry - high))
            least += (near * near)[at]
            most += (far * far)[at]
        for row in least <= most.min(axis=1, keepdims=True):
            yield np.flatnonzero(row)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries to compare each part with, one after the other, and the borders between parts."""
        cells = np.ascontiguousarray(x // self.cell)
        if not cells.shape[1]:
            return np.zeros(len(x), np.int64), np.arange(len(x) + 1)
        keys, first, at = np.unique(cells.view(f"V{cells.itemsize * cells.shape[1]}").ravel(), return_index=True, return_inverse=True)
        names = [k.tobytes() for k in keys]
        new = [i for i, k in enumerate(names) if k not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(range(len(names)))
        for i, found in zip(new, self.undominated(cells[first[new]])):
            self.memo[names[i]] = found
        lists = [self.memo[k] for k in names]
        sizes = np.array([len(s) for s in lists])
        flat, starts = np.concatenate(lists), np.concatenate(([0], np.cumsum(sizes)))
        borders = np.concatenate(([0], np.cumsum(sizes[at])))
        return flat[np.repeat(starts[:-1][at] - borders[:-1], sizes[at]) + np.arange(borders[-1])], borders

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part and its squared distance."""
        entry, borders = self.candidates(x)
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        start = 0
        while start < len(x):
            end = max(start + 1, int(np.searchsorted(borders, borders[start] + TOGETHER, side="right")) - 1)
            some, own = entry[borders[start]:borders[end]], borders[start:end + 1] - borders[start]
            apart = np.repeat(x[start:end], np.diff(own), axis=0) - self.entries[some]
            distance = np.einsum("ij,ij->i", apart, apart)
            best = np.minimum.reduceat(distance, own[:-1])
            hits = np.flatnonzero(distance == np.repeat(best, np.diff(own)))
            code[start:end], error[start:end] = some[hits[np.searchsorted(hits, own[:-1])]], best
            start = end
        return code, error


def matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, length)


def _sums(books: np.ndarray, cell: int):
    """Of all parts a task holds, by (part, entry): how many, and their components added up."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b, cell) for b in books]
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, parts * width)
                for p, book in enumerate(coded):
                    own = x[:, p * width:(p + 1) * width]
                    code, _ = book.nearest(own)
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    totals[p, used, 0] += np.diff(np.append(first, len(code)))
                    if width:
                        totals[p, used, 1:] += np.add.reduceat(own[order], first, axis=0)
        slot = np.flatnonzero(totals.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(totals.ravel()[slot])], ["slot", "total"])
    return run


def _encode(books: np.ndarray, cell: int):
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b, cell) for b in books]
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, parts * width)
                found = [book.nearest(x[:, p * width:(p + 1) * width]) for p, book in enumerate(coded)]
                text = digits[found[0][0]]
                for code, _ in found[1:]:
                    text = np.char.add(text, digits[code])
                given = [batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*given, pa.array(text.tolist(), pa.string()), pa.array(sum(e for _, e in found))],
                                                 ["vec_id", "label", "code", "error"])
    return run


def train(rows: DataFrame, parts: int, width: int, entries: int, rounds: int, cell: int) -> np.ndarray:
    """The final codebooks, (parts, entries, width)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sums = rows.select("v").mapInArrow(_sums(books, cell), "slot bigint, total bigint").groupBy("slot").agg(F.sum("total"))
        totals = np.zeros((parts, len(first), width + 1), np.int64)
        for slot, total in sums.collect():
            totals.ravel()[slot] = total
        used = totals[:, :, 0] > 0
        books[used] = totals[used][:, 1:] // totals[used][:, :1]
    return books


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
           cell: int = 32) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every row that takes part, and the codebooks: two hex digits or more
    per part, and the squared distance from what the code stands for."""
    importable(vectors.sparkSession)
    rows, width = whole_numbers(vectors.select("vec_id", "embedding", "label"), scale, parts)
    books = train(rows, parts, width, entries, rounds, cell)
    kinds = dict(rows.dtypes)
    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    return stored(rows.mapInArrow(_encode(books, cell), shape), "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The codes with the errors of all rows of the label added up."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def listed(books: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))
