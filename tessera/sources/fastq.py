"""A batch data source for sequencing reads: four-line records of plain or gzipped files, under a budget.

    register(spark); spark.read.format("fastq").option("maxReads", 2000).load("folder/*.fastq.gz")

A file is one partition. Reading ends at ``maxReads`` records or ``maxBytes`` decompressed
bytes, whichever comes first; the last row of a file then says truncated, as it does when a
file ends inside a record. A damaged gzip stream gives the records before the damage and ok =
false on the last row; a file without a whole record gives one row with null read_ix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, read_ix long, name string, seq string, qual string, truncated boolean, ok boolean"
CHUNK = 1 << 18


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def split_uri(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def expand(path: str) -> list[str]:
    """Files of a path, folder or a pattern in the last name."""
    import fnmatch

    fs, at = split_uri(path)
    folder, _, name = at.rpartition("/")
    if any(c in name for c in "*?["):
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, name)]
    elif (info := fs.get_file_info(at)).type == pafs.FileType.Directory:
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(info.path, recursive=True)) if f.is_file]
    else:
        found = [at]
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(scheme + f for f in found)


def lines(stream, gzipped: bool, most: int) -> Iterator[tuple[bytes, str]]:
    """Lines without their ends, and why reading ended last: "", "cut" (budget or no line end) or "bad" (gzip)."""
    inflate = zlib.decompressobj(31) if gzipped else None
    rest, read, state, fed = b"", 0, "", False
    while read < most:
        raw = stream.read(CHUNK)
        if not raw:
            if inflate and fed and not inflate.eof:
                state = "cut"
            break
        if inflate:
            data = b""
            try:
                while raw:
                    fed = True
                    data += inflate.decompress(raw, max(1, most - read - len(data)))
                    if inflate.eof:  # members follow each other
                        raw, inflate, fed = inflate.unused_data, zlib.decompressobj(31), False
                    else:
                        raw = inflate.unconsumed_tail if read + len(data) < most else b""
            except zlib.error:
                state = "bad"
            raw = data
        if read + len(raw) >= most:
            raw, state = raw[: most - read], "cut"
        read += len(raw)
        *whole, rest = (rest + raw).split(b"\n")
        for line in whole:
            yield line.rstrip(b"\r"), ""
        if state == "bad":
            break
    if rest and not state:
        yield rest.rstrip(b"\r"), ""
    yield b"", state or "end"


def records(stream, gzipped: bool, most_reads: int, most_bytes: int) -> Iterator[tuple]:
    """(read_ix, name, seq, qual, truncated, ok) rows, one held back for what the end tells."""
    held, block, n, state = None, [], 0, "end"
    for line, ended in lines(stream, gzipped, most_bytes):
        if ended:
            state = ended
            break
        block.append(line)
        if len(block) == 4:
            if n == most_reads:
                state = "cut"
                break
            if not block[0].startswith(b"@") or not block[2].startswith(b"+"):
                state = "bad"
                break
            if held:
                yield (*held, False, True)
            head, seq, _, qual = (b.decode("latin-1") for b in block)
            held, block, n = (n, head[1:], seq, qual), [], n + 1
    cut = state == "cut" or state == "end" and any(block)
    yield (*(held or (None, None, None, None)), cut, state != "bad")


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most_reads = int(options.get("maxreads", options.get("maxReads", 2000)))
        self.most_bytes = int(options.get("maxbytes", options.get("maxBytes", 256 << 20)))

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in expand(self.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        fs, at = split_uri(partition.path)
        with fs.open_input_stream(at, compression=None) as f:
            for row in records(f, at.endswith(".gz"), self.most_reads, self.most_bytes):
                yield (partition.path, *row)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
