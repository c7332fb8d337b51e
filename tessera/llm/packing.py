"""Packing: order-preserving dynamic programming over cut positions.

The token stream of each range of documents is cut into windows of at most ``limit`` tokens.
A cut may lie after a document (free), after a sentence (``sentence_cost``) or, where neither
comes for a while, inside a sentence (``split_cost``). With best[j] the least cost of all
windows up to position j,

    best[j] = cost(j) + limit - j + min(best[i] + i  for j - limit <= i < j),

and the minimum over the sliding range comes from a monotone queue, so the whole search takes
linear time."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.bpe import encoder, tokenizer_path
from tessera.llm.common import arrow_limits, in_id_order, slices, utf8

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def best_cuts(positions: np.ndarray, costs: np.ndarray, limit: int) -> list[int]:
    """The ends of the windows of least padding plus cut costs.

    positions: ascending cut candidates from above 0 to the last token, no gap over ``limit``."""
    at = [0, *positions.tolist()]
    extra = [0, *costs.tolist()]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # indices with rising best + position
    keys = [0] * len(at)
    for j in range(1, len(at)):
        low = at[j] - limit
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best[j], back[j] = keys[i] + extra[j] + limit - at[j], i
        keys[j] = key = best[j] + at[j]
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of tokenised documents; holds about ``block`` tokens and one document."""

    def __init__(self, sentence_end: np.ndarray, limit: int, sentence_cost: int, split_cost: int, split_every: int, block: int):
        self.sentence_end, self.limit, self.block = sentence_end, limit, block
        self.sentence_cost, self.split_cost, self.split_every = sentence_cost, split_cost, split_every
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int | None, int, int]] = []  # id, place of the first token (below 0: already written), tokens
        self.sequence = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.held, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def candidates(self, ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost = np.full(len(ids) + 1, -1, np.int64)
        ends = self.sentence_end[ids]
        ends[:-1] &= ~ends[1:]  # after the last mark of a run
        cost[np.flatnonzero(ends) + 1] = self.sentence_cost
        cost[doc_ends] = 0
        cost[len(ids)] = max(cost[len(ids)], 0)
        at = np.flatnonzero(cost >= 0)
        gaps = np.diff(np.concatenate([[0], at]))
        for k in np.flatnonzero(gaps > self.split_every).tolist():
            lo = int(at[k] - gaps[k])
            cost[lo + self.split_every : at[k] : self.split_every] = self.split_cost
        at = np.flatnonzero(cost >= 0)
        at = at[at > 0]
        return at, cost[at]

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of all windows but the open one, which waits for more; at the last call of all."""
        if not self.held:
            return None
        ids = np.concatenate(self.ids)
        doc_lo = np.array([lo for _, lo, _ in self.docs])
        doc_n = np.array([n for _, _, n in self.docs])
        cuts = best_cuts(*self.candidates(ids, doc_lo + doc_n), self.limit)
        if not last:
            cuts.pop()
        done = cuts[-1] if cuts else 0
        window = np.array([0, *cuts])
        edges = np.unique(np.concatenate([np.maximum(doc_lo, 0), window]))
        edges = edges[edges <= done]
        lo, hi = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_lo, lo, "right") - 1
        seq = np.searchsorted(window, lo, "right") - 1
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        out = [pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()), lo - doc_lo[doc], hi - lo, pa.array(crc, pa.int64()), doc_n[doc], seq + self.sequence, lo - window[seq]]
        self.sequence += len(cuts)
        self.docs = [(i, a - done, n) for i, a, n in self.docs if a + n > done]
        self.ids, self.held = ([ids[done:]] if done < len(ids) else []), len(ids) - done
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=pa.schema(FIELDS))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, end_id: int | None = 1, sentence_cost: int = 2, split_cost: int = 8, split_every: int = 64, block: int = 1 << 20) -> DataFrame:
    """Packs ``docs`` (doc_id, text; other columns are left out) into sequences of at most ``limit`` tokens.

    Documents are taken in ascending doc_id (nulls first, ties by text hash) within ranges of
    ids; each range is packed by itself, so at most one sequence per range ends early. Inside a
    range the search starts anew every ``block`` tokens: cuts are the best of each block. Returns
    a row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (of
    little-endian unsigned 32-bit ids), doc_tokens (with ``end_id``), sequence_id and offset
    (the place in the sequence, gapless from 0). A null or empty text is its end id alone, or
    no piece without an ``end_id``; equal rows are packed as often as they come; no row gives
    no piece; a document longer than ``limit`` goes over several sequences."""
    path = tokenizer or tokenizer_path()
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        ends = np.zeros(enc.tokenizer.get_vocab_size() + 1, bool)
        for word, i in enc.tokenizer.get_vocab().items():
            ends[i] = word[-1:] in ".!?Ċ"  # the last stands for a line feed in byte-level vocabularies
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        packer = Packer(ends, limit, sentence_cost, split_cost, split_every, block)
        packer.sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for lo, hi in slices(batch, bounds, 1 << 19):
                ids, at = enc.encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                for k in range(hi - lo):
                    packer.add(names[lo + k], np.concatenate([ids[at[k] : at[k + 1]], tail]))
                if packer.held >= block:
                    yield packer.flush(last=False)
        if (rest := packer.flush(last=True)) is not None:
            yield rest

    return in_id_order(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
