from __future__ import annotations

import random
import re

from tessera.llm.minhash import components, drop_near_duplicates, near_duplicates


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def chain_rows():
    """Chains of texts that differ step by step, exact copies, and unrelated texts."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(5000)}"
    rows, i = [], 0
    for _ in range(12):
        text = [word() for _ in range(rng.choice([4, 7, 60, 150]))]
        for _ in range(rng.randrange(1, 12)):
            rows.append((i, " ".join(text)))
            i += 1
            if rng.random() < 0.7:
                text = [*text]
                text[rng.randrange(len(text))] = word()
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = chain_rows()
    for percent in (85, 80):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, percent)


def test_awkward_rows(docs, rows, none):
    plain = [(i, t) for i, t, *_ in rows if i is not None]
    got = near_duplicates(docs, percent=80)
    assert sorted(tuple(r) for r in got.where("doc_id is not null").collect()) == brute(plain, 80)
    (alone,) = got.where("doc_id is null").collect()
    assert alone.kept and alone.component_id is None
    assert near_duplicates(none).collect() == []
    kept = drop_near_duplicates(docs, percent=80)
    assert kept.columns == docs.columns
    want = {i for i, _, _, keep in brute(plain, 80) if keep}
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
