"""Benchmark decontamination by winnowing.

A winnowed text keeps the least 5-gram hash of every 6 consecutive 5-grams: the fingerprint of
a window of 10 words. Two texts that share 10 words share such a window and so its
fingerprint: no shared span of 10 words can be missed. Documents and benchmark items are
joined on fingerprints; where a fingerprint hits, the document's windows around it are
extended to 10 words and joined with the items' windows. Items of fewer than 10 words are one
window each, and their fingerprint is the hash of all their words. What a document gathers
is a subset of its own windows, and the ids of the items that have them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import RangeHash, arrow_limits, ascii_lower, matching_rows, slices, stored, utf8, words_of

WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False  # after A-Z have been lowered

GRAM = 5
#: Item fingerprints up to which tasks get them as an array of 8 MB; beyond, all document fingerprints go into the join.
MOST_HELD = 1 << 20
#: Bytes of candidate rows up to which they are broadcast.
MOST_BROADCAST = 8 << 20


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = ascii_lower(data)
    lo, hi, first = words_of(low, bounds, WORD)
    return RangeHash(low).of(lo, hi), first


def grams(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text, and the n + 1 bounds."""
    many = np.maximum(np.diff(first) - width + 1, 0)
    ends = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[:-1] - ends[:-1], many) + np.arange(ends[-1])
    return RangeHash(words).of(at, at + width), ends


def window_marks(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of ``window`` words of the texts: its fingerprint, its first word, and the text's number."""
    hashes, ends = grams(words, first, GRAM)
    span = window - GRAM + 1
    many = np.maximum(np.diff(first) - window + 1, 0)
    owner = np.repeat(np.arange(len(many)), many)
    inside = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    if not len(owner):
        return hashes[:0], inside, owner
    least = np.lib.stride_tricks.sliding_window_view(hashes, span).min(axis=1)
    return least[ends[:-1][owner] + inside], first[:-1][owner] + inside, owner


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, width, hash, fp: the windows of the items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                words, first = word_hashes(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                fp, at, owner = window_marks(words, first, window)
                n = np.diff(first)
                few = np.flatnonzero((n > 0) & (n < window))
                short = RangeHash(words).of(first[few], first[few + 1])
                owner, width = np.concatenate([owner, few]), np.concatenate([np.full(len(owner), window), n[few]])
                hashes = np.concatenate([RangeHash(words).of(at, at + window), short])
                cols = [batch.column("item_id")[lo:hi].take(pa.array(owner)), pa.array(width.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (hashes, np.concatenate([fp, short])))]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "width", "hash", "fp"])

    return items.mapInArrow(run, "item_id string, width long, hash long, fp long")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _document_windows(texts: DataFrame, window: int, short: list[int], known: np.ndarray | None, what: str) -> DataFrame:
    """text_key and, without repeats inside a text, each fingerprint (what: "fp") or the hash of each window whose fingerprint is known ("hash").

    known: fingerprints; if None, those in the column fps of each row count. Texts of any length also give their runs of the ``short`` lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                words, first = word_hashes(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                allowed = known
                if known is None and what == "hash":
                    allowed = np.unique(batch.column("fps")[lo:hi].flatten().to_numpy().view(np.uint64))
                fp, at, owner = window_marks(words, first, window)
                if what == "hash":
                    hit = _among(fp, allowed)
                    at, owner = at[hit], owner[hit]
                    fp = RangeHash(words).of(at, at + window)
                found = [(fp, owner)]
                for width in short:
                    hashes, ends = grams(words, first, width)
                    hit = np.ones(len(hashes), bool) if what == "fp" else _among(hashes, allowed)
                    found.append((hashes[hit], np.repeat(np.arange(hi - lo), np.diff(ends))[hit]))
                fp, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.lexsort((fp, owner))
                fp, owner = fp[by], owner[by]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("text_key")[lo:hi].take(pa.array(owner[new])), pa.array(fp[new].view(np.int64))], ["text_key", what])

    return texts.mapInArrow(run, f"text_key long, {what} long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """What of each document is in benchmark items.

    Words are runs of 0-9, a-z and all characters from U+0080 on, with A-Z lowered. Per row of
    ``docs`` (doc_id, text; other columns are left out): doc_id, n_words, n_hit (words inside
    an occurrence of a window), n_items (distinct item_ids with an occurring window),
    items_sha256 (of those ids, sorted as strings, comma-joined), contaminated (n_hit > 0). A
    window is ``window`` consecutive words of an item (item_id, text); an item of fewer, but
    not none, is one window. Null and empty texts have no words; a null item_id counts as the
    empty string; repeated rows of either table change nothing; without items nothing is hit."""
    spark = docs.sparkSession
    arrow_limits(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    windows = stored(_item_windows(items, window).distinct(), "item-windows")
    short = sorted(r["width"] for r in windows.where(F.col("width") < window).select("width").distinct().collect())  # a few numbers
    marks = stored(windows.select("fp").distinct(), "item-marks")

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    if marks.count() <= MOST_HELD:
        known = np.unique(np.array([r["fp"] for r in marks.toLocalIterator()], np.int64).view(np.uint64))
        own = _document_windows(texts.select("text_key", "text"), window, short, known, "hash")
    else:
        hits = _document_windows(texts.select("text_key", "text"), window, short, None, "fp").distinct().join(marks, "fp")
        fps = stored(hits.groupBy("text_key").agg(F.collect_set("fp").alias("fps")), "hit-marks")
        own = _document_windows(texts.select("text_key", "text").join(fps, "text_key"), window, short, None, "hash")
    hits = stored(own.distinct().join(windows.select("width", "hash").distinct(), "hash"), "hit-windows")
    ids = hits.join(windows.select("hash", "item_id"), "hash").select("text_key", "item_id").distinct().groupBy("text_key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    ids = ids.select("text_key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    # both lists are of the text's own distinct windows, at most
    likely = stored(hits.groupBy("text_key").agg(F.collect_list("width").alias("widths"), F.collect_list("hash").alias("hashes")).join(ids, "text_key"), "likely")
    size = likely.agg(F.sum(16 * F.size("hashes") + 128)).first()[0] or 0
    rows = texts.join(F.broadcast(likely) if size <= MOST_BROADCAST else likely, "text_key", "left")
    rows = rows.select("doc_id", "text", "widths", "hashes", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                low = ascii_lower(data[bounds[lo] : bounds[hi]])
                start, end, first = words_of(low, bounds[lo : hi + 1] - bounds[lo], WORD)
                hit, bytes_hash = [0] * (hi - lo), None
                for k, hashes in enumerate(batch.column("hashes")[lo:hi]):
                    if hashes.is_valid:
                        bytes_hash = bytes_hash or RangeHash(low)
                        words = bytes_hash.of(start[first[k] : first[k + 1]], end[first[k] : first[k + 1]])
                        widths, known = np.array(batch.column("widths")[lo + k].as_py()), np.array(hashes.as_py(), np.int64).view(np.uint64)
                        marked = np.zeros(len(words) + 1, np.int64)
                        for width in np.unique(widths).tolist():
                            own = grams(words, np.array([0, len(words)]), width)[0]
                            at = np.flatnonzero(_among(own, np.unique(known[widths == width])))
                            np.add.at(marked, at, 1)
                            np.add.at(marked, at + width, -1)
                        hit[k] = int((np.cumsum(marked) > 0).sum())
                cols = [batch.column("doc_id")[lo:hi], pa.array(np.diff(first), pa.int64()), pa.array(hit, pa.int64()), *(batch.column(c)[lo:hi] for c in ("n_items", "items_sha256")), pa.array([h > 0 for h in hit])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs``, all columns, without rows whose text holds a window of a benchmark item; texts decide, not ids."""
    keyed = docs.select(F.xxhash64("text").alias("__key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    marked = contamination(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, window)
    gone = stored(marked.where("contaminated").select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return matching_rows(keyed, gone, "__key", "left_anti").select("__row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM d, (SELECT DISTINCT l FROM bw) AS ls, unnest(range(1, len(w) - l + 2)) AS t(i)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, k)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + l)) AS t(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
