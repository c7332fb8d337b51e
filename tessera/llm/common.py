"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import Scratch, shared_dir, stored  # noqa: F401  the operators take them from here


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column on end, and the n + 1 bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]] if len(bounds) else data[:0], bounds - bounds[0]


def slices(rows: pa.RecordBatch | pa.Array, bounds: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch or column with about ``limit`` bytes of text each; a longer text is a range of its own."""
    lo, n = 0, rows.num_rows if isinstance(rows, pa.RecordBatch) else len(rows)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mix of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit hashes of many ranges of one array: prefix sums of a polynomial modulo 2**64, then mixed."""

    BASE = 0x9E3779B97F4A7C15 | 1
    KEPT = 1 << 19  # powers that a worker keeps; longer arrays have their own
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        if len(self._powers) < n + 1:
            size = max(1 << 19, n + 1)
            up, down = np.full(size, self.BASE, np.uint64), np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._powers, self._inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if size <= self.KEPT:
                RangeHash._powers, RangeHash._inverse = self._powers, self._inverse
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (self.sums[hi] - self.sums[lo]) * self._inverse[lo]
        return mix64(h + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def arrow_limits(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """Arrow batches towards Python hold so many rows and bytes at most (a longer row is a batch of its own)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def in_id_order(docs: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id and text in ascending doc_id over ranges; ties by a hash of the text, so that repeated ids spread too."""
    by = ["doc_id", "__tie"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__tie"))
    return rows.repartitionByRange(n or partitions(docs.sparkSession), *by).sortWithinPartitions(*by).drop("__tie")


#: Rows of (id) up to which a side of a join is broadcast: about 16 MB as a hash table.
MOST_BROADCAST_IDS = 400_000


def matching_rows(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``key`` is (left_semi) or isn't (left_anti) in ``ids``, a stored table of distinct keys.

    Below a counted size the ids are broadcast and the rows, with their texts, stay where
    they are; beyond it Spark shuffles both sides."""
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids, key, how)


def words_of(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, for the n + 1 text bounds, the number of the first word at or after each.

    in_word: for each of the 256 byte values, whether it belongs to words."""
    n = len(data)
    inside = in_word[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    lo, hi = np.flatnonzero(start), np.flatnonzero(end) + 1
    return lo, hi, np.searchsorted(lo, bounds)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
