"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A data file holds one record per document, without gaps:

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the length field
    payload  8 bytes little-endian document id (its own flag bit says null), 1 byte width, ids
             as little-endian unsigned integers of that width (2 or 4 bytes)
    check    4 bytes: masked CRC-32 of the payload

The mask rotates the checksum right by 15 bits and adds a constant, so that checksums of data
that hold checksums stay useful. The index beside a data file has the 8-byte offset of every
record: records can be read in any order without a scan."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder, tokenizer_path
from tessera.llm.common import arrow_limits, in_id_order, partitions, shared_dir, slices, utf8

MASK = 0xA282EAD8  # fixed value of the record format
HEAD, CHECK, LEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = HEAD.pack(len(payload))
    return b"".join((head, CHECK.pack(masked(head)), payload, CHECK.pack(masked(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return LEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = LEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=LEAD.size)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def read_record(stream) -> bytes | None:
    """The next record's payload; None at the end. Raises on a wrong checksum or a cut record."""
    head = stream.read(HEAD.size + CHECK.size)
    if not head:
        return None
    if len(head) < HEAD.size + CHECK.size or CHECK.unpack_from(head, HEAD.size)[0] != masked(head[: HEAD.size]):
        raise ValueError("damaged record length")
    n = HEAD.unpack_from(head)[0]
    body = stream.read(n + CHECK.size)
    if len(body) < n + CHECK.size or CHECK.unpack_from(body, n)[0] != masked(body[:n]):
        raise ValueError("damaged record payload")
    return body[:n]


def read_at(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record of a data file by its number, through the index: a shuffled read."""
    fs, at = _open(path)
    with fs.open_input_file(at + ".index") as f:
        offset = HEAD.unpack(f.read_at(8, 8 * number))[0]
    with fs.open_input_file(at) as f:
        f.seek(offset)
        return ids_of(read_record(f))


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes one data file and index per range of ascending doc_id.

    ``folder`` must be reachable from all executors. Every attempt of a task writes files of
    its own name; the manifest that is returned (shard, path, records, tokens, bytes), itself
    a table beside them, names those of the attempts that ended, so lost executors and
    repeated tasks leave no wrong record. A null or empty text is its end id alone; null ids
    come first; repeated rows give a record each; an empty table gives an empty manifest."""
    path = tokenizer or tokenizer_path()
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc = encoder(path)
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        out, starts, at, tokens = None, [], 0, 0
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for lo, hi in slices(batch, bounds, 1 << 19):
                ids, ends = enc.encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                out = out or fs.open_output_stream(name)
                for k in range(hi - lo):
                    own = np.concatenate([ids[ends[k] : ends[k + 1]], tail])
                    record = framed(payload_of(names[lo + k], own))
                    out.write(record)
                    starts.append(at)
                    at += len(record)
                    tokens += len(own)
        if out:
            out.close()
            with fs.open_output_stream(name + ".index") as f:
                f.write(np.array(starts, "<u8").tobytes())
            scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [scheme + name], "records": [len(starts)], "tokens": [tokens], "bytes": [at]})

    manifest = in_id_order(docs).mapInArrow(run, "shard long, path string, records long, tokens long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_records(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Every record of the files that ``manifest`` names, with all checks.

    doc_id, start (ids of all records before it, over all files), n_tokens, ids_crc32 (of
    little-endian unsigned 32-bit ids) and, with ``ids``, token_ids."""
    spark = manifest.sparkSession
    # a row per file: their number is that of the partitions written
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                fs, at = _open(path)
                start, rows, held = before, [], 0
                with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                    while (payload := read_record(f)) is not None:
                        doc_id, own = ids_of(payload)
                        rows.append((doc_id, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), *([own.astype(np.int64)] * ids)))
                        start += len(own)
                        held += len(own) * ids + 1
                        if held > 1 << 16:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("token_ids", pa.list_(pa.int64()))] * ids)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * ids
    return files.repartition(partitions(spark), "path").mapInArrow(run, schema)


def records_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """``write_records`` to a new shared folder, then ``read_records``."""
    return read_records(write_records(docs, shared_dir(docs.sparkSession, "records"), tokenizer, end_id))
