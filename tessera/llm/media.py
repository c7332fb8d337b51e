"""Media columns: Netpbm and BMP images to numpy arrays, area-resized tiles in NPY form, difference hashes.

Area averages come from an integral image: with S the sums over all pixels above and left of
a corner, linear between pixel corners, a box's sum is four values of S, also for boxes that
end inside a pixel."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_limits, stored, utf8

_HEADER = re.compile(rb"P([1-6])(?:\s+|#[^\n]*\n)*")
_NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_netpbm(blob: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples of a P1 to P6 file; bitmaps as 0 and 1, 1 being black."""
    head = _HEADER.match(blob)
    if not head:
        raise ValueError("not a Netpbm file")
    kind, at, numbers = int(head[1]), head.end(), []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _NUMBER.match(blob, at)
        if not m:
            raise ValueError("cut Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = (*numbers, 1)[:3]
    if not width or not height or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = int(np.prod(shape))
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\n]*|\s+", b"", blob[at:]), np.uint8)[:count] - 48
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*", b"", blob[at:]).split()[:count], np.int64)
    elif kind == 4:
        row = -(-width // 8)
        raw = np.frombuffer(blob, np.uint8, min(row * height, len(blob) - at - 1), at + 1)
        if len(raw) < row * height:
            raise ValueError("cut Netpbm raster")
        values = np.unpackbits(raw.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        kind_ = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(blob) - at - 1 < count * kind_.itemsize:
            raise ValueError("cut Netpbm raster")
        values = np.frombuffer(blob, kind_, count, at + 1)
    if len(values) < count:
        raise ValueError("cut Netpbm raster")
    return values.reshape(shape).astype(np.uint8 if top < 256 else np.uint16)


def encode_pgm(image: np.ndarray) -> bytes:
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + image.astype(np.uint8).tobytes()


def decode_bmp(blob: bytes) -> np.ndarray:
    """(height, width, 3) samples, red first, of an uncompressed BMP of 8, 24 or 32 bits a pixel."""
    if blob[:2] != b"BM" or len(blob) < 54:
        raise ValueError("not a BMP file")
    u32 = lambda at: int.from_bytes(blob[at : at + 4], "little")
    start, head, width = u32(10), u32(14), int.from_bytes(blob[18:22], "little", signed=True)
    height, bits, packing = int.from_bytes(blob[22:26], "little", signed=True), int.from_bytes(blob[28:30], "little"), u32(30)
    if packing or bits not in (8, 24, 32) or width < 1 or not height:
        raise ValueError("BMP form not supported")
    row = (width * bits + 31) // 32 * 4
    raw = np.frombuffer(blob, np.uint8, -1, start)
    if len(raw) < row * abs(height):
        raise ValueError("cut BMP raster")
    raw = raw[: row * abs(height)].reshape(abs(height), row)
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        colours = np.frombuffer(blob, np.uint8, 4 * (u32(46) or 256), 14 + head).reshape(-1, 4)
        if raw[:, :width].max() >= len(colours):
            raise ValueError("BMP pixel outside its palette")
        return colours[raw[:, :width]][:, :, 2::-1].copy()
    return raw[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP of (height, width, 3) samples, red first."""
    height, width, _ = image.shape
    row = (width * 24 + 31) // 32 * 4
    raster = np.zeros((height, row), np.uint8)
    raster[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    n = lambda x, size=4: x.to_bytes(size, "little")
    return b"BM" + n(54 + raster.size) + n(0) + n(54) + n(40) + n(width) + n(height) + n(1, 2) + n(24, 2) + n(0) * 6 + raster.tobytes()


def decode(blob: bytes) -> np.ndarray:
    return decode_bmp(blob) if blob[:2] == b"BM" else decode_netpbm(blob)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])  # fixed values: the usual luma weights


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal boxes of the image, as float64."""
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.float64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    for axis, n in ((0, height), (1, width)):
        at = np.arange(n + 1) * (image.shape[axis] / n)
        lo = np.minimum(at.astype(np.int64), image.shape[axis] - 1)
        part = (at - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        sums = np.take(sums, lo, axis) * (1 - part) + np.take(sums, lo + 1, axis) * part
    boxes = np.diff(np.diff(sums, axis=0), axis=1)
    return boxes / (image.shape[0] / height * image.shape[1] / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: in an 8 x 9 area-resized grey image, whether each value is less than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(blob: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(blob), allow_pickle=False)


def media_tiles(rows: DataFrame, key: str, media: str, size: int | None = 64) -> DataFrame:
    """NPY tiles and difference hashes of a binary column of Netpbm or BMP files.

    Per row: ``key``, tile (NPY of a ``size`` x ``size`` grey uint8 image; with size None of
    the image as it is), height, width, feature (difference hash) and error. Media that is
    null or can't be decoded gives nulls and says why in error; equal media gives equal values;
    other columns are left out."""
    key_type = rows.schema[key].dataType.simpleString()
    arrow_limits(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column("media").to_pylist():
                try:
                    if blob is None:
                        raise ValueError("no media")
                    image = decode(blob)
                    tile = image if size is None else np.rint(area_resize(grey(image), size, size)).astype(np.uint8)
                    out.append((to_npy(tile), image.shape[0], image.shape[1], difference_hash(image), None))
                except ValueError as e:
                    out.append((None, None, None, None, str(e)))
            types = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *cols], [key, "tile", "height", "width", "feature", "error"])

    return rows.select(key, rows[media].alias("media")).mapInArrow(run, f"{key} {key_type}, tile binary, height int, width int, feature string, error string")


WIDTH = 64


def text_media(docs: DataFrame) -> DataFrame:
    """Texts as images and back: doc_id, n_bytes and media, a binary column of PGM files of 64 pixels a row.

    The UTF-8 bytes of a text (null: none) are the pixels, with zeros up to a positive whole
    number of rows."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            media = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                pixels = np.zeros(max(1, -(-(b - a) // WIDTH)) * WIDTH, np.uint8)
                pixels[: b - a] = data[a:b]
                media.append(encode_pgm(pixels.reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def text_tiles(docs: DataFrame) -> DataFrame:
    """Every text of ``docs`` (doc_id, text; other columns are left out) as a lossless NPY tile, stored and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of all and of the last 64
    payload bytes read back), media_bytes and media_sha256 (of the tile as stored) and feature
    (difference hash). A null or empty text is one row of zeros; repeated rows repeat."""
    media = text_media(docs)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = [to_npy(decode(blob)) for blob in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tiles, pa.binary())], ["doc_id", "n_bytes", "tile"])

    tiles = stored(media.mapInArrow(store, "doc_id long, n_bytes long, tile binary"), "tiles")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column("tile").to_pylist():
                image = from_npy(blob)
                payload = image.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), difference_hash(image)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], names)

    return tiles.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
