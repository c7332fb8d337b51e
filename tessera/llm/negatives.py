"""Hard negatives by bit-sliced integer products.

Vectors are integers; a row's component is read bit plane by bit plane, the most significant
first. After each plane an anchor's score with a row lies in a known interval: what the
planes so far give, plus between nothing and all of the bits left times the anchor's
negative and positive components. A row whose interval can't reach an anchor's window, or its
worst entry of a list that is full already, is dropped; what comes through the last plane is exact.

The stated query set (anchors) meets all rows in blocks: rows are dealt into groups, each
group of blocks meets every block of anchors, and only the best of a group leave the
task. First the positives are found among blocks that share a label, then the negatives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, arrow_limits, partitions, stored

ROWS = 2048  # vectors of a block
BLOCKS = 8  # blocks of rows in a group, about
TILE = 256  # anchors whose intervals are held at once
SPARSE = 16  # from here on, one live pair in so many, pairs are followed one by one
NONE = np.iinfo(np.int64).min

BLOCK = "block long, dim int, labels array<long>, kinds array<long>, ids array<long>, values binary"


def quantized(vectors: DataFrame, scale: int, shift: tuple[int, int] | None) -> DataFrame:
    """vec_id, label, embedding of the rows that take part: one row for each vec_id."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    if shift:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % shift[0] == 0, (F.col("label") + 1) % shift[1]).otherwise(F.col("label")))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * float(scale)).cast("long")))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")


def _blocks(rows: DataFrame, extra: str | None = None) -> DataFrame:
    """Blocks of up to ``ROWS`` vectors of near labels: ids, labels, kinds (the distinct labels), values (little-endian 64-bit integers by row) and ``extra`` (an array of longs of fixed length by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                lists = part.column("embedding")
                sizes = np.diff(lists.offsets.to_numpy())
                dim = int(sizes.max())
                values = np.zeros((part.num_rows, dim), "<i8")
                values[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy()
                labels = part.column("label").to_numpy()
                out = [[0], [dim], [labels], [np.unique(labels)], [part.column("vec_id").to_numpy()], [values.tobytes()]]
                if extra:
                    out.append([part.column(extra).flatten().to_numpy()])
                kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=False)], ["block", "dim", "labels", "kinds", "ids", "values", extra or ""][: len(out)])

    by = ["label", "spread"]
    dealt = rows.withColumn("spread", F.xxhash64("vec_id")).repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("spread")
    return dealt.mapInArrow(run, BLOCK + (f", {extra} array<long>" if extra else "")).withColumn("block", F.monotonically_increasing_id())


def planes(values: np.ndarray, real: type) -> list[tuple[int, np.ndarray]]:
    """Weight and 0/1 matrix of each bit plane of signed integers, the most significant (the sign) first."""
    top = max(int(values.max(initial=0)).bit_length(), (-1 - int(values.min(initial=0))).bit_length()) + 1
    return [(-(1 << b) if b == top - 1 else 1 << b, (values >> b & 1).astype(real)) for b in range(top - 1, -1, -1)]


def within(sliced: list[tuple[int, np.ndarray]], anchors: np.ndarray, low: np.ndarray, high: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and exact score of the live (row, anchor) pairs whose score lies in the anchor's [low, high]."""
    real = sliced[0][1].dtype
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    across, score = anchors.T.astype(real), np.zeros(live.shape, real)
    for k, (weight, plane) in enumerate(sliced):
        score += plane @ across * real.type(weight)
        left = abs(weight) - 1 if k else (1 << len(sliced) - 1) - 1
        live = live & (score >= low - left * up) & (score <= high - left * down)
        if np.count_nonzero(live) * SPARSE <= live.size:
            break
    row, col = np.nonzero(live)
    score = score[row, col]
    for weight, plane in sliced[k + 1 :]:
        score = score + np.einsum("ij,ij->i", plane[row], across.T[col]) * real.type(weight)
        left = weight - 1
        keep = (score >= (low - left * up)[col]) & (score <= (high - left * down)[col])
        row, col, score = row[keep], col[keep], score[keep]
    return row, col, score.astype(np.int64)


def first_of(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group its first ``k`` by falling score, then rising id."""
    order = np.lexsort((ident, -score, group))
    group, score, ident = group[order], score[order], ident[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.concatenate([start, [len(group)]])))
    return group[rank < k], score[rank < k], ident[rank < k]


class Lists:
    """The best rows seen so far for each window of the anchors of one block."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k  # anchors by windows
        self.full = np.full(low.shape, -np.inf)  # the worst score of a full list
        self.group, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """What a score must reach, and must not exceed, to enter any list of an anchor."""
        return np.maximum(self.low, self.full).min(1), self.high.max(1)

    def add(self, col: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        at, window = np.nonzero((score[:, None] >= np.maximum(self.low, self.full)[col]) & (score[:, None] <= self.high[col]))
        group = np.concatenate([self.group, col[at] * self.low.shape[1] + window])
        self.group, self.score, self.ident = first_of(group, np.concatenate([self.score, score[at]]), np.concatenate([self.ident, ident[at]]), self.k)
        last = np.flatnonzero(self.group[self.k - 1 :] == self.group[: len(self.group) - self.k + 1]) + self.k - 1 if len(self.group) >= self.k else np.zeros(0, int)
        self.full.ravel()[self.group[last]] = self.score[last]


def _wide(values: bytes, n: int, dim: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), np.int64)
    out[:, :dim] = np.frombuffer(values, "<i8").reshape(n, dim)
    return out


def _unsent(table: DataFrame) -> DataFrame:
    """``table``, never broadcast in the next join: Spark goes by the size of its compressed files, a small part of that in the driver's memory."""
    return table.hint("merge")


def _mined(rows: DataFrame, anchors: DataFrame, groups: int, same: bool, k: int, least: int, most: int) -> DataFrame:
    """anchor_id, window, vec_id, score: the first ``k`` rows of each group of blocks for each window of an anchor.

    With ``same`` rows of the anchor's label in one window without bounds; else rows of other
    labels in a window for each of the anchor's ``scores``: least * positive <= 100 * score <= most * positive."""

    def opened(batch: dict) -> Lists:
        n = len(batch["anchor_ids"])
        if same:
            return Lists(np.full((n, 1), -np.inf), np.full((n, 1), np.inf), k)
        p = np.asarray(batch["scores"], np.int64).reshape(n, -1)
        empty = (p == NONE) | (least * p > most * p)
        p = np.where(empty, 0, p)
        return Lists(np.where(empty, np.inf, -(-least * p // 100)), np.where(empty, -np.inf, most * p // 100), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray, Lists] | None = None
        sliced_of, sliced = None, []

        def done() -> pa.RecordBatch:
            ids, lists = held[1], held[2]
            anchor, window = np.divmod(lists.group, lists.low.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(ids[anchor]), pa.array(window, pa.int32()), pa.array(lists.ident), pa.array(lists.score)], ["anchor_id", "window", "vec_id", "score"])

        for batch in batches:
            for x in batch.to_pylist():
                ids, rids = np.asarray(x["anchor_ids"], np.int64), np.asarray(x["ids"], np.int64)
                if not held or held[0] != x["anchor_block"]:
                    if held:
                        yield done()
                    held = (x["anchor_block"], ids, opened(x))
                width = max(x["dim"], x["anchor_dim"])
                a = _wide(x["anchor_values"], len(ids), x["anchor_dim"], width)
                q = _wide(x["values"], len(rids), x["dim"], width)
                largest = width * (1 + int(np.abs(a).max(initial=0))) * 4 * (1 + int(np.abs(q).max(initial=0)))
                if largest >= 1 << 53:
                    raise ValueError("scores of these vectors need more than 53 bits: take a smaller scale")
                if sliced_of != (x["block"], width, largest < 1 << 24):
                    sliced_of, sliced = (x["block"], width, largest < 1 << 24), planes(q, np.float32 if largest < 1 << 24 else np.float64)
                la, lr = np.asarray(x["anchor_labels"], np.int64), np.asarray(x["labels"], np.int64)
                low, high = held[2].bounds()
                found = []
                for t in range(0, len(ids), TILE):
                    c = slice(t, t + TILE)
                    live = (lr[:, None] == la[None, c]) if same else (lr[:, None] != la[None, c])
                    live &= (rids[:, None] != ids[None, c]) & (low <= high)[None, c]
                    if live.any():
                        row, col, score = within(sliced, a[c], low[c], high[c], live)
                        found.append((col + t, score, rids[row]))
                if found:
                    held[2].add(*(np.concatenate(part) for part in zip(*found, strict=True)))
        if held:
            yield done()

    named = anchors.select(F.col("block").alias("anchor_block"), F.col("dim").alias("anchor_dim"), F.col("labels").alias("anchor_labels"), F.col("kinds").alias("anchor_kinds"), F.col("ids").alias("anchor_ids"), F.col("values").alias("anchor_values"), *([] if same else ["scores"]))
    cells = named.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    met = cells.join(_unsent(dealt), (cells["group"] == dealt["group"]) & F.arrays_overlap("anchor_kinds", "kinds") if same else cells["group"] == dealt["group"])
    columns = ["anchor_block", "anchor_dim", "anchor_labels", "anchor_ids", "anchor_values", "block", "dim", "labels", "ids", "values", *([] if same else ["scores"])]
    return met.select(*columns).mapInArrow(run, "anchor_id long, window int, vec_id long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group by falling score, then rising vec_id, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame, *, anchors: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, shift: tuple[int, int] | None = None
) -> DataFrame:
    """Hard negatives for each anchor and positive.

    vectors: vec_id, label, embedding; other columns are left out. Rows with a null vec_id,
    label or vector, or any null or non-finite component, take no part; of rows with one vec_id
    the one of the least label, then vector, does. ``shift`` (n, m): where vec_id is divisible by n,
    label becomes (label + 1) % m first. Components become floor(scale * x); a shorter vector has
    zeros behind its end. A score is the inner product of a row with an anchor; higher scores come first,
    ties by smaller vec_id. Anchors are the rows for which ``anchors`` holds (default: vec_id divisible
    by 50), positives an anchor's first ``positives`` other rows of its label.

    Returns for each anchor and positive the first ``negatives`` rows of other labels with
    least * positive_score <= 100 * score <= most * positive_score: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. Anchors without positives and positives
    without such rows have none, an empty table neither. Scores must stay below 2 ** 53."""
    spark = vectors.sparkSession
    arrow_limits(spark, rows=ROWS, size="8m")
    scratch = Scratch()
    rows = scratch.stored(quantized(vectors, scale, shift), "vectors")
    queries = rows.where(F.col("vec_id") % 50 == 0 if anchors is None else anchors)
    blocks = scratch.stored(_blocks(rows), "blocks")
    count = blocks.count()
    groups = max(1, min(count, max(2 * partitions(spark), math.ceil(count / BLOCKS))))

    best = _ranked(_mined(blocks, _blocks(queries), groups, True, positives, least, most), ["anchor_id"], positives)
    best = scratch.stored(best.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = best.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x.positive_score).alias("scores"))
    padded = F.concat("scores", F.array_repeat(F.lit(NONE), F.lit(positives) - F.size("scores")))
    asked = queries.join(_unsent(lists.select(F.col("anchor_id").alias("vec_id"), padded.alias("scores"))), "vec_id")
    found = _ranked(_mined(blocks, _blocks(asked, "scores"), groups, False, negatives, least, most), ["anchor_id", "window"], negatives)
    found = found.withColumn("place", F.col("window") + 1).join(_unsent(best), ["anchor_id", "place"])
    result = stored(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    scratch.drop()
    return result


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
