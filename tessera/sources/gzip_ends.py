"""A batch data source for the two ends of gzip files: the trailer, and what a prefix of the bytes inflates to.

    register(spark); spark.read.format("gzip_ends").option("prefixBytes", 65536).load("folder/*.gz")

A row for each file: size_bytes; isize, the uncompressed size modulo 2**32 that the last four bytes state (null for a file of
fewer); prefix, the bytes that the first ``prefixBytes`` compressed ones give, ``maxBytes`` at most; compressed_read; cut: whether the
stream goes on behind the prefix; ok: false if it is damaged or no gzip, when prefix holds what came before the damage. No file is read whole."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.fastq import FilePartition, expand, split_uri

SCHEMA = "file string, size_bytes long, isize long, prefix binary, compressed_read long, cut boolean, ok boolean"


def inflated(raw: bytes, most: int) -> tuple[bytes, bool, bool]:
    """What gzip bytes give, ``most`` bytes at most; whether the last member goes on behind it; whether it is sound."""
    out, stream = bytearray(), zlib.decompressobj(31)
    while raw:
        if len(out) >= most:
            return bytes(out), True, True
        try:
            out += stream.decompress(raw, most - len(out))
        except zlib.error:
            return bytes(out), True, False
        if not stream.eof:
            return bytes(out), True, True
        raw = stream.unused_data  # members follow each other
        stream = zlib.decompressobj(31)
    return bytes(out), False, True


class GzipEndsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.prefix = int(options.get("prefixbytes", options.get("prefixBytes", 65536)))
        self.most = int(options.get("maxbytes", options.get("maxBytes", 1 << 20)))

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in expand(self.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        fs, at = split_uri(partition.path)
        with fs.open_input_file(at) as f:
            size = f.size()
            head = f.read(min(self.prefix, size))
            isize = int.from_bytes(f.read_at(4, size - 4), "little") if size >= 4 else None
        data, goes_on, ok = inflated(head, self.most)
        yield partition.path, size, isize, data, len(head), goes_on or len(head) < size, ok


class GzipEndsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_ends"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GzipEndsReader:
        return GzipEndsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GzipEndsSource)


def prefix_records(ends: DataFrame, most: int = 2000) -> DataFrame:
    """file, records: the whole four-line records of a prefix, ``most`` at most, as structs of name and length; the one that is cut is left out."""
    lines = F.split(F.decode("prefix", "ISO-8859-1"), "\n")
    # what stands behind the last line end is cut, or nothing
    rows = ends.select("file", F.slice(lines, F.lit(1), F.size(lines) - 1).alias("lines"))
    at = lambda k: F.get("lines", k)
    starts = F.when(F.size("lines") >= 4, F.sequence(F.lit(0), F.size("lines") - 4, F.lit(4))).otherwise(F.array().cast("array<int>"))
    records = F.transform(F.filter(starts, lambda k: at(k).startswith("@")), lambda k: F.struct(at(k).alias("name"), F.length(at(k + 1)).alias("length")))
    return rows.select("file", F.slice(records, 1, most).alias("records"))
