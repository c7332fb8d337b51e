"""Sharding: a uniform shuffle with exact shard sizes, from a hypergeometric communication matrix.

How many of partition p's rows a uniformly random permutation of all rows sends to shard s
is multivariate hypergeometric. The matrix of these counts is drawn first, from row counts
alone; then each partition orders its rows at random and deals them out by its matrix row,
and after the exchange each shard orders what it got at random. Every permutation of the rows
over the shards' slots is equally likely, and shard sizes are exact, at most one apart."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

MOST_PARTITIONS = 1 << 16


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of good + bad without replacement, by inversion.

    Weights are relative to the mode's, by their ratios from one value to the next, so that no
    large logarithms cancel; those over 14 standard deviations away are below 1e-40."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    reach = int(14 * (draws * (good / total) * (bad / total) * (total - draws) / (total - 1)) ** 0.5) + 64
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    up = (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))  # from k to k + 1
    at = mode - low
    weights = np.concatenate([np.cumprod(1 / up[:at][::-1])[::-1], [1.0], np.cumprod(up[at:])])
    sums = np.cumsum(weights)
    return low + int(min(np.searchsorted(sums, rng.random() * sums[-1], "right"), len(sums) - 1))


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts by partition and shard with these row sums, column sums at most one apart, drawn exactly."""
    rng, total = random.Random(seed), sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        out, rest = [], sum(room)
        for s in range(shards):
            rest -= room[s]
            got = _hypergeometric(rng, room[s], rest, n)
            n -= got
            out.append(got)
        room = [r - g for r, g in zip(room, out, strict=True)]
        matrix.append(out)
    return matrix


def shard_uniformly(rows: DataFrame, identity: list[str], shards: int = 24, seed: int = 7, bucket_rows: int = 1 << 20) -> DataFrame:
    """``rows`` with __shard (int, 0 to shards - 1) and __slot (long, gapless from 0 in each shard).

    ``identity``: columns that, with a row's place in its partition, the random order is
    derived from: equal rows are dealt independently. The rows with their places are kept in the
    shared folder, so that the counts and the dealing see the same partitions even if a task
    runs twice. The driver draws (partitions x shards) counts, for at most 65,536 partitions;
    more are joined first. Rows of a shard are ordered in buckets of about ``bucket_rows``,
    so no shard is a single task. An empty table gives an empty result."""
    spark = rows.sparkSession
    # the local permutation
    place = F.monotonically_increasing_id()
    rows = rows.coalesce(MOST_PARTITIONS).withColumn("__key", F.xxhash64(F.lit(seed), place, *identity)).sortWithinPartitions("__key")
    rows = stored(rows.withColumn("__place", place).drop("__key"), "shard-places")
    rows = rows.withColumn("__part", F.shiftright("__place", 33)).withColumn("__rank", F.col("__place").bitwiseAND((1 << 33) - 1))
    counts = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    total = sum(n for _, n in counts)
    ends = []
    for (part, _), dealt in zip(counts, communication_matrix([n for _, n in counts], shards, seed), strict=True):
        run, bounds = 0, []
        for n in dealt:
            run += n
            bounds.append(run)
        ends.append((part, bounds))
    matrix = spark.createDataFrame(ends, "__part long, __ends array<long>")
    rows = rows.join(matrix, "__part").withColumn("__shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))))
    # the permutation inside each shard: by a random key, whose leading values name a bucket
    buckets = max(1, -(-total // (shards * bucket_rows)))
    key = F.xxhash64(F.lit(seed + 1), "__place", *identity)
    rows = rows.withColumn("__key", key).withColumn("__bucket", F.floor((F.col("__key") / 2.0**64 + 0.5) * buckets).cast("int"))
    held = rows.groupBy("__shard", "__bucket").count()
    before = held.select("__shard", "__bucket", F.coalesce(F.sum("count").over(Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    slot = F.row_number().over(Window.partitionBy("__shard", "__bucket").orderBy("__key", "__place"))
    out = rows.withColumn("__slot", slot.cast("long") - 1).join(before, ["__shard", "__bucket"])
    return out.withColumn("__slot", F.col("__slot") + F.col("__before")).drop("__part", "__rank", "__ends", "__key", "__bucket", "__before", "__place")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """The shard and slot of every row of ``docs`` (doc_id, text; other columns are left out).

    doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32 (null: of no
    bytes), law ("rows": row counts of shards are at most one apart), shard, slot and
    grown_shard (null: the law keeps no row in place when a shard is added). Repeated rows and
    null ids are dealt like any others."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_uniformly(rows, ["doc_id", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
