"""Whitelists as sorted codes: written as differences, read back by prefix sums, named by the set they hold.

A barcode is a two-bit code; a whitelist is its distinct codes in order. Its file holds the difference of each code to the one before,
little-endian, compressed: few bits where a code needs 32 or 64. Codes are sorted over all tasks by ranges; their pieces are gzip
members, and members on end are one gzip stream. Only the last code of each piece is carried to the next."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.scratch import stored

LETTERS = np.frombuffer(b"ACGT", np.uint8)
CHUNK = 1 << 20  # codes of a piece
#: A code's long in the order of unsigned codes.
UNSIGNED = "code ^ shiftleft(-1L, 63)"


def code_type(width: int) -> np.dtype:
    """The smallest type that holds codes of so many bases: 32 bits up to 16 bases, 64 up to 32."""
    if not 1 <= width <= 32:
        raise ValueError(f"barcodes of 1 to 32 bases have codes, not of {width}")
    return np.dtype("<u4" if width <= 16 else "<u8")


def codes(barcodes: DataFrame, width: int) -> DataFrame:
    """Distinct codes (as a long whose bits are the unsigned code's) of barcodes (barcode) of this width and A, C, G, T alone; others, nulls too, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.full(256, 255, np.uint8)
        value[LETTERS] = np.arange(4)
        for batch in batches:
            data = np.frombuffer("".join(batch.column("barcode").to_pylist()).encode(), np.uint8).reshape(-1, width)
            out = np.zeros(len(data), np.uint64)
            for k in range(width):
                out = out << np.uint64(2) | value[data[:, k]].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["code"])

    code_type(width)
    clean = barcodes.select("barcode").where(F.col("barcode").rlike(f"^[ACGT]{{{width}}}$")).distinct()
    return clean.mapInArrow(run, "code long")


def encode(barcodes: DataFrame, width: int, piece_size: int = CHUNK) -> DataFrame:
    """part (from 0), n, first, last, data: a whitelist in pieces in order, ``data`` being gzip members of differences. first and last: codes as longs.

    The pieces' bytes in order of part are one file: its first difference is the first code. A piece holds ``piece_size`` codes at most."""
    kind = code_type(width)
    names = ["task", "piece", "n", "first", "last", "steps"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)

        def row(own: np.ndarray) -> pa.RecordBatch:
            steps = gzip.compress(np.diff(own).astype(kind).tobytes(), 6, mtime=0)
            ends = own[[0, -1]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (task, piece, len(own), *ends.tolist())] + [pa.array([steps], pa.binary())], names)

        for batch in batches:
            held = np.concatenate([held, batch.column("code").to_numpy().view(np.uint64)])
            while len(held) >= piece_size:
                yield row(held[:piece_size])
                piece, held = piece + 1, held[piece_size:]
        if len(held):
            yield row(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, before = (batch.column(c).to_numpy().view(np.uint64) for c in ("first", "before"))
            heads = (first - before).astype(kind)
            data = [gzip.compress(h.tobytes(), 6, mtime=0) + d for h, d in zip(heads, batch.column("steps").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "n", "first", "last")), pa.array(data, pa.binary())], ["part", "n", "first", "last", "data"])

    dealt = codes(barcodes, width).withColumn("order", F.expr(UNSIGNED)).repartitionByRange("order").sortWithinPartitions("order").select("code")
    rows = stored(dealt.mapInArrow(pieces, "task long, piece long, n long, first long, last long, steps binary"), "pieces")
    # a row for each piece
    order = Window.orderBy("task", "piece")
    ends = rows.select("task", "piece", (F.row_number().over(order) - 1).alias("part"), F.coalesce(F.lag("last").over(order), F.lit(0)).alias("before"))
    return rows.join(ends, ["task", "piece"]).select("part", "n", "first", "last", "before", "steps").mapInArrow(joined, "part int, n long, first long, last long, data binary")


def decode(parts: DataFrame, width: int) -> DataFrame:
    """barcode of every code of the ranges (part, data) of one whitelist: prefix sums in each, after the sums of those before it."""
    kind = code_type(width)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(gzip.decompress(d), kind).sum(dtype=np.uint64)) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(np.array(sums, np.uint64).view(np.int64))], ["part", "total"])

    # one number for each piece
    sums = parts.select("part", "data").mapInArrow(total, "part int, total long")
    before = F.sum(F.col("total").cast("decimal(38,0)")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("part", F.coalesce(before.cast("string"), F.lit("0")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist(), strict=True):
                steps = np.frombuffer(gzip.decompress(data), kind).astype(np.uint64)
                own = np.cumsum(steps, dtype=np.uint64) + np.uint64(int(start) % (1 << 64))
                for lo in range(0, len(own), CHUNK):
                    some = own[lo : lo + CHUNK]
                    text = np.empty((len(some), width), np.uint8)
                    for k in range(width):
                        text[:, k] = LETTERS[(some >> np.uint64(2 * (width - 1 - k)) & np.uint64(3)).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in text.view(f"S{width}").ravel()], pa.string())], ["barcode"])

    return parts.select("part", "data").join(starts, "part").mapInArrow(run, "barcode string")


def set_identity(barcodes: DataFrame, width: int) -> DataFrame:
    """n, sha256: the number of distinct barcodes, and a hash of their sorted codes: of the set, whatever the order, repeats or packing.

    A hash is one chain, so the sorted codes stream through one task; eight bytes each, and none is held."""
    kind = code_type(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            own = batch.column("code").to_numpy().view(np.uint64).astype(kind)
            digest.update(own.tobytes())
            n += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([digest.hexdigest()])], ["n", "sha256"])

    found = codes(barcodes, width).repartition(1).sortWithinPartitions(F.expr(UNSIGNED)).mapInArrow(run, "n long, sha256 string")
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("sha256"))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """barcode of every line of text that holds one, plain or gzipped; white space around it goes."""
    return spark.read.text(path).select(F.trim("value").alias("barcode")).where("barcode <> ''")


def write_whitelist_text(barcodes: DataFrame, path: str) -> None:
    """The distinct barcodes as sorted lines, over as many files as there are ranges."""
    barcodes.select("barcode").where("barcode is not null").distinct().repartitionByRange("barcode").sortWithinPartitions("barcode").write.text(path)
