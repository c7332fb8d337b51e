"""Near-duplicates over whole tables and families of copies: no link lost against exact similarity; the filters are bounds."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.test_minhash import shingles
from tessera.llm.common import Scratch
from tessera.llm.minhash import _halved, bitmaps, near_duplicates, possible, prefix_pairs


def exact_links(rows, percent):
    """All links by counting common shingles, pair by pair."""
    sets = [shingles(t) for _, t in rows]
    holders, common = defaultdict(list), defaultdict(int)
    for k, own in enumerate(sets):
        for x in own:
            for other in holders[x]:
                common[other, k] += 1
            holders[x].append(k)
    return sets, [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def expected(rows, percent):
    sets, links = exact_links(rows, percent)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def families(rng, without_base=False):
    """Copies with ever more changed words, some groups without the text they come from, and passages that many texts share."""
    word = lambda: f"v{rng.randrange(9000)}"
    passage = [word() for _ in range(50)]
    texts = []
    for size, length in ((150, 140), (60, 90), (40, 400), (30, 25)):
        base = [word() for _ in range(length)]
        texts += [] if without_base else [base]
        for _ in range(size):
            copy = [*base]
            for _ in range(rng.randrange(1, 1 + length // 12)):
                copy[rng.randrange(length)] = word()
            texts.append(copy)
    texts += [[word() for _ in range(rng.randrange(20, 120))] + passage + [word() for _ in range(rng.randrange(20, 120))] for _ in range(150)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent,m,without_base", [(85, 10, False), (80, 12, True)])
def test_families_equal_exact_similarity(spark, percent, m, without_base):
    rows = families(random.Random(percent), without_base)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, m=m).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, percent)


def test_a_whole_table_equals_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = near_duplicates(docs, percent=85, m=10).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, 85)


def test_prefix_pairs_lose_no_link(spark):
    rows = families(random.Random(3))
    sets, links = exact_links(rows, 80)
    texts = spark.createDataFrame(rows, "cls long, text string")
    component = texts.selectExpr("cls", "cls as component")
    pairs = {frozenset(r) for r in prefix_pairs(texts, component, 5, 80, Scratch()).collect()}
    assert {frozenset(x) for x in links} <= pairs
    assert len(pairs) < 0.5 * len(rows) ** 2 / 2


def test_bitmaps_are_a_bound(spark):
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1)
    sets = [np.unique(rng.choice(pool[: k * 3], k)) for k in (1, 2, 15, 16, 17, 60, 64, 65, 70, 1000, 1020, 1030, 1200)]
    sets += [np.unique(np.concatenate([s[: len(s) * 19 // 20 + 1], pool[-1 - len(s) // 20 :]])) for s in sets]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    words, at = bitmaps(np.concatenate(sets), ends)
    own = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for s, w in zip(sets, own, strict=True):
        assert len(w) * 64 >= 4 * len(s) and np.bitwise_count(w).sum() <= len(s)
        if len(w) > 1:
            wider = {int(x >> np.uint64(64 - int(np.log2(len(w) * 64)) + 1)) for x in s}
            assert {k for k in range(len(w) * 32) if int(_halved(w)[k // 64]) >> k % 64 & 1} == wider
    rows, near = [], set()
    for a in range(len(sets)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) * 100 >= max(len(sets[a]), len(sets[b])) * 80:
                rows.append((a, b, len(sets[a]), len(sets[b]), own[a].view(np.int64).tolist(), own[b].view(np.int64).tolist()))
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    near.add((a, b))
    pairs = spark.createDataFrame(rows, "a long, b long, n_a long, n_b long, bits_a array<long>, bits_b array<long>")
    kept = {tuple(r) for r in possible(pairs, 80).collect()}
    assert near <= kept and len(near) > 5
