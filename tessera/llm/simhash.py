"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into blocks. Two fingerprints that differ in at most ``most``
bits agree on all but ``most`` of the blocks, so every choice of ``blocks - most`` blocks is a
key under which such a pair meets; pairs are then verified on their Hamming distance. Equal
fingerprints are one class and meet nobody twice.

Keys that more than ``BUCKET`` classes share are not compared pair by pair: their members
get narrower keys, made of the same blocks and, by the same rule, of blocks of the bits left.
After three such cuts at most ``LEFT`` bits are free, so that no more than ``BUCKET`` fingerprints can share a key: every bucket that is compared is bounded, whatever the data. A bucket gives
the edges of a spanning forest of its links, never all its pairs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MOST_BROADCAST_IDS, Scratch, arrow_limits, ascii_lower, matching_rows, slices, stored, utf8, words_of
from tessera.llm.minhash import WORD, components

BUCKET = 256  # distinct fingerprints that are compared with each other
LEFT = 8  # bits that may still be free in the narrowest keys: 2 ** LEFT <= BUCKET
CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprints(data: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit SimHash of each text on end, zero for one without words.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lowered; a shingle is
    ``width`` words joined by one space (of a shorter text its whole sequence), repeats
    included, hashed by XXH64 with seed 42. A bit is set if it is in over half of the hashes."""
    low = ascii_lower(data)
    lo, hi, first = words_of(low, bounds, WORD)
    # the words on end, with one space behind each
    size = hi - lo + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(ends[-1], 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[ends[1:] - 1] = False
    joined[inside] = low[WORD[low]]
    text = joined.tobytes()
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[:-1] - starts[:-1], many) + np.arange(starts[-1])
    begin, end = ends[at], ends[at + np.repeat(np.minimum(n, width), many)] - 1
    owner = np.repeat(np.arange(len(n)), many)
    counts = np.zeros((len(n), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for c in range(0, len(at), CHUNK):
        hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(begin[c : c + CHUNK].tolist(), end[c : c + CHUNK].tolist(), strict=True)), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = owner[c : c + CHUNK]
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        counts[of[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > many[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprinted(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row of docs (doc_id, text); null text has no words."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                fp = fingerprints(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cuts(bits: list[int], blocks: int, most: int) -> list[list[int]]:
    """Bit sets that two fingerprints can be held together by: all choices of ``blocks - most`` blocks of ``bits``."""
    edges = [round(k * len(bits) / blocks) for k in range(blocks + 1)]
    parts = [bits[a:b] for a, b in itertools.pairwise(edges)]
    return [sum(chosen, []) for chosen in itertools.combinations(parts, blocks - most)]


def key_bits(classes: int, most: int) -> list[list[int]]:
    """The bit sets of the first keys: the fewest blocks with which hardly any two of so many random fingerprints meet."""
    blocks = most + 2
    while blocks < most + 6 and classes * 4 > 2 ** (64 * (blocks - most) // blocks):
        blocks += 1
    return _cuts(list(range(64)), blocks, most)


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _key(mask: Column) -> Column:
    """The bucket of fp under a mask, the bits that hold it together."""
    return F.xxhash64(mask, F.col("fp").bitwiseAND(mask))


def _narrower(bits: list[int], most: int) -> list[list[int]]:
    """The bit sets of the narrower keys under a bit set: the bits left are cut by the same rule."""
    return [bits + cut for cut in _cuts([b for b in range(64) if b not in bits], 2 * most, most)]


def _narrower_masks(rows: DataFrame, most: int) -> DataFrame:
    """mask, masks: the narrower masks of those in use, of which there are as many as choices of blocks, whatever the data."""
    used = [[b for b in range(64) if r.mask >> b & 1] for r in rows.select("mask").distinct().collect()]
    return rows.sparkSession.createDataFrame([(_mask(bits), [_mask(m) for m in _narrower(bits, most)]) for bits in used], "mask long, masks array<long>")


def buckets(classes: DataFrame, most: int, scratch: Scratch) -> Iterator[DataFrame]:
    """Tables (key, fps) of at most ``BUCKET`` fingerprints each, in which all pairs of ``classes`` (fp) at distance ``most`` or less meet."""
    first = F.array(*(F.lit(_mask(bits)) for bits in key_bits(classes.count(), most)))
    keyed = classes.select("fp", F.explode(first).alias("mask")).select("fp", "mask", _key(F.col("mask")).alias("key"))
    while True:
        shared = scratch.stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        met = scratch.stored(matching_rows(keyed, shared.where(f"size <= {BUCKET}").select("key"), "key"), "met")
        yield met.groupBy("key").agg(F.collect_list("fp").alias("fps"))
        wide = shared.where(f"size > {BUCKET}").select("key")
        if wide.isEmpty():
            return
        full = scratch.stored(matching_rows(keyed, wide, "key").select("fp", "mask"), "wide")
        # under a narrower mask that several wide buckets lead to, a fingerprint stands once
        rows = full.join(F.broadcast(_narrower_masks(full, most)), "mask").select("fp", F.explode("masks").alias("mask"))
        rows = scratch.stored(rows.distinct(), "narrow")
        keyed = rows.select("fp", "mask", _key(F.col("mask")).alias("key"))


def forest(found: DataFrame, most: int) -> DataFrame:
    """Edges a, b of a spanning forest of the links within each bucket (fps): distinct fingerprints at distance ``most`` or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            a, b = [], []
            two = np.flatnonzero(sizes == 2)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            one, other = flat[ends[two]], flat[ends[two] + 1]
            near = np.bitwise_count((one ^ other).view(np.uint64)) <= most
            a.append(one[near])
            b.append(other[near])
            for k in np.flatnonzero(sizes > 2).tolist():
                fps = flat[ends[k] : ends[k + 1]]
                away = np.ones(len(fps), bool)
                for start in range(len(fps)):
                    if away[start]:
                        away[start] = False
                        front = [start]
                        while front:
                            x = front.pop()
                            new = np.flatnonzero(away & (np.bitwise_count((fps ^ fps[x]).view(np.uint64)) <= most))
                            away[new] = False
                            a.append(np.full(len(new), fps[x]))
                            b.append(fps[new])
                            front += new.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])

    return found.select("fps").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most ``most`` (1 to 4) bits.

    Per row of ``docs`` (doc_id, text; other columns are left out): doc_id, fingerprint (16
    lowercase hex digits) and component_id, the smallest doc_id reachable over links, its own
    included. The fingerprint of a null text and of one without words is zero and links like any
    other. Rows with one doc_id count as a document each; rows without one link too, and
    get the component's smallest doc_id, null where it has none. An empty table gives an
    empty result."""
    scratch = Scratch()
    rows = stored(fingerprinted(docs, width), "fingerprints")
    classes = scratch.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    edges = None
    for found in buckets(classes.select("fp"), most, scratch):
        links = scratch.stored(forest(found, most), "links")
        edges = links if edges is None else edges.union(links)
    near = scratch.stored(components(edges), "near")
    # only classes with links or several rows get their name from elsewhere
    named = classes.join(near.withColumnRenamed("node", "fp"), "fp", "left").where("component is not null or rows > 1")
    named = scratch.stored(named.select("fp", "rep", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = stored(named.join(least, "component").select("fp", "component_id"), "names")
    scratch.drop()
    few = names.count() <= MOST_BROADCAST_IDS
    found = rows.join(F.broadcast(names) if few else names, "fp", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
