from __future__ import annotations

import random
import zlib
from collections import Counter
from math import comb

from tessera.llm.sharding import _hypergeometric, communication_matrix, shard_documents


def test_matrix_sums():
    rows = [5, 0, 17, 1, 40]
    matrix = communication_matrix(rows, 6, 3)
    assert [sum(r) for r in matrix] == rows
    assert sorted({sum(c) for c in zip(*matrix, strict=True)}) in ([10, 11], [10], [11])


def test_draws_follow_the_hypergeometric_law():
    rng, n = random.Random(2), 40000
    seen = Counter(_hypergeometric(rng, 4, 6, 5) for _ in range(n))
    for k in range(5):
        p = comb(4, k) * comb(6, 5 - k) / comb(10, 5)
        assert abs(seen[k] / n - p) < 0.012


def test_every_row_has_one_place(spark, docs, rows, none):
    got = shard_documents(docs, shards=5).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(5))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert shard_documents(none).collect() == []


def test_places_are_uniform(spark):
    """Over seeds, each of four rows comes to each of two shards' slots about equally often."""
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(4)], "doc_id long, text string").repartition(2)
    seen = Counter()
    for seed in range(40):
        seen.update((r.doc_id, r.shard, r.slot) for r in shard_documents(rows, shards=2, seed=seed).collect())
    # chi-square of 16 cells of 10 each has mean 16 or less; over 45 is a chance below 1e-4
    assert sum((seen[k, s, t] - 10) ** 2 / 10 for k in range(4) for s in range(2) for t in range(2)) < 45


def test_copies_are_dealt_like_other_rows(spark):
    """480 copies of one row beside 480 others in one partition: about half of each of 24 shards, and of their first slots, are copies."""
    rows = spark.createDataFrame([(0, "copy")] * 480 + [(k, f"t{k}") for k in range(1, 481)], "doc_id long, text string").coalesce(1)
    got = shard_documents(rows, shards=24, seed=5).collect()
    copies = Counter(r.shard for r in got if r.doc_id == 0)
    assert sum((copies[s] - 20) ** 2 for s in range(24)) / 9.6 < 60  # variance 40 / 4 * 920 / 959
    early = Counter(r.slot < 20 for r in got if r.doc_id == 0)
    assert abs(early[True] - 240) < 50


def test_draws_from_many_rows_keep_their_law():
    rng, good, bad, draws = random.Random(4), 10**12 // 24, 10**12 - 10**12 // 24, 10**7
    seen = [_hypergeometric(rng, good, bad, draws) for _ in range(3000)]
    mean = draws / 24
    sd = (draws / 24 * 23 / 24) ** 0.5
    assert abs(sum(seen) / len(seen) - mean) < 5 * sd / len(seen) ** 0.5
    assert 0.9 < (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5 / sd < 1.1
