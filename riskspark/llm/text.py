"""Words of many texts at once, on the bytes of an Arrow column.

All functions take a piece of a batch: the UTF-8 bytes of its texts one after
another and the offsets of the texts. A piece holds half a megabyte of text, or
one text if that is longer, so memory does not grow with the batch. Word
borders are ASCII characters in every rule used here, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskspark.session import importable

PIECE_BYTES = 1 << 19
U = np.uint64
#: Odd multipliers of the word hash and of a 64-bit mixing step.
BASE, MIX1, MIX2, GOLD = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def _lowering() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _class(spans: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for low, high in spans:
        t[low:high + 1] = True
    return t


LOWER = _lowering()
#: Word characters: everything but blanks; digits, a-z and all beyond ASCII.
NOT_BLANK = _class([(0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF)])
ALNUM = _class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches: texts are long, and executors small."""
    importable(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column, nulls as empty texts."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of rows with about ``size`` bytes."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        end = min(end, n)
        yield start, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the border indices of each text's words."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


STEPS = np.arange(1, 65, dtype=np.uint64) * GOLD
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingles(hashes: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the borders of each text's runs.

    A text of fewer words, but not none, gives its whole sequence as one.
    """
    counts = np.diff(borders)
    n_runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate(([0], np.cumsum(n_runs)))
    text = np.repeat(np.arange(len(counts)), n_runs)
    first = borders[:-1][text] + (np.arange(at[-1]) - at[:-1][text])
    length = np.minimum(counts, width)[text]
    out = length.astype(np.uint64) * GOLD
    for j in range(width):
        have = length > j
        value = mix(hashes[np.where(have, first + j, 0)] + STEPS[j])
        out = np.where(have, out * BASE + value, out)
    return mix(out), at


def contiguous_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    padded = np.concatenate(([False], mask, [False]))
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return change[::2], change[1::2]
