from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.common import Scratch
from tessera.llm.simhash import buckets, fingerprints, forest, key_bits, simhash_components


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, most=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    return [(i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps, most), strict=True)]


def brute_components(ids, fps, most):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(fps))]


def key(row):
    return tuple((x is None, x) for x in row)


def test_awkward_rows_equal_brute_force(docs, rows, none):
    got = sorted((tuple(r) for r in simhash_components(docs).collect()), key=key)
    assert got == sorted(brute([r[:2] for r in rows]), key=key)
    assert simhash_components(none).collect() == []
    assert simhash_components(none).columns == ["doc_id", "fingerprint", "component_id"]


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, simhash_components(docs).collect())) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_families_of_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 200, 900]))]
        for _ in range(60):
            text = [*base]
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 241, " ".join(text)))
    got = sorted(map(tuple, simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute(rows))


def test_hot_buckets_are_cut_and_lose_no_link(spark, monkeypatch):
    """Thousands of distinct fingerprints around one: every cut is needed, buckets stay bounded, components are exact."""
    monkeypatch.setattr(simhash, "BUCKET", 32)
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    while len(fps) < 900:
        fps.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 14, rng.integers(1, 9)))))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    fps = sorted(fps)
    scratch, edges, levels = Scratch(), set(), 0
    for found in buckets(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, scratch):
        levels += 1
        assert all(len(set(r.fps)) == len(r.fps) <= 32 for r in found.collect())
        edges |= {(r.a, r.b) for r in forest(found, 3).collect()}
    assert levels > 1
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    place = {f: k for k, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[root(place[a])] = root(place[b])
    mine = {}
    for k in range(len(fps)):
        mine.setdefault(root(k), k)
    want = brute_components(list(range(len(fps))), fps, 3)
    assert [mine[root(k)] for k in range(len(fps))] == want


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_keys_hold_every_near_pair(most):
    rng = random.Random(most)
    for classes in (100, 10**8, 10**12):
        held = [sum(1 << b for b in bits) for bits in key_bits(classes, most)]
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), most))
            assert any(x & m == y & m for m in held)


def test_narrowest_keys_leave_few_bits():
    for held in (key_bits(100, 3), key_bits(10**12, 3)):
        for _ in range(3):
            held = [narrow for bits in held[:4] for narrow in simhash._narrower(bits, 3)]
        assert max(64 - len(bits) for bits in held) <= simhash.LEFT


def test_long_texts_are_counted_in_chunks(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (1, 2, 3, 4, 700, 0, 333)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert fingerprints(data, bounds, 3).tolist() == [brute_fingerprint(t) for t in texts]
