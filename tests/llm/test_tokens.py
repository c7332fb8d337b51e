"""Packing, token counts and token records against the tokenizers library."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import records
from tessera.llm.bpe import BatchEncoder, load, tokenizer_path
from tessera.llm.common import shared_dir
from tessera.llm.packing import best_cuts, pack_documents
from tessera.llm.token_counts import PrefixCounter, cut_to_budget, token_counts, unpack_counts

ODD = ["", " ", "a", "I'll we've don't it's", "x  y\n\n z\t\t", "  lead", "trail  ", " nb sp　", "١٢٣ 12.5", "ﬁ ß İ", "🙂🙂👩‍👩‍👧", "a" * 300, "<|endoftext|>", "x<|endoftext|> y", "é é", "'s 'll' 'x", "\r\n\r\n a"]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected(text, end):
    return [*load(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, end]


def test_batch_encoder_equals_library():
    encoder, library = BatchEncoder(tokenizer_path()), load(tokenizer_path())
    raw = [t.encode() for t in ODD]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    for k, t in enumerate(ODD):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_prefix_counts_equal_library():
    counter, library = PrefixCounter(tokenizer_path()), load(tokenizer_path())
    for text in ODD:
        counts, at = counter.counts(text), 0
        for k in range(len(text) + 1):
            assert counts[at] == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)
            at += len(text[k].encode()) if k < len(text) else 0


def test_best_cuts_are_least_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        total, limit = rng.randrange(4, 14), rng.randrange(2, 6)
        costs = [rng.randrange(0, 6) for _ in range(total)]
        cuts = best_cuts(np.arange(1, total + 1), np.array(costs), limit)

        def price(ends, costs=costs, limit=limit):
            return sum(limit - (b - a) + costs[b - 1] for a, b in zip([0, *ends], ends, strict=False))

        ways = (
            [*some, total]
            for n in range(total)
            for some in itertools.combinations(range(1, total), n)
            if all(b - a <= limit for a, b in zip([0, *some], [*some, total], strict=True))
        )
        assert price(cuts) == min(map(price, ways))
        assert all(0 < b - a <= limit for a, b in zip([0, *cuts], cuts, strict=False))


def test_packing_keeps_every_id_once(docs, rows, none):
    got = pack_documents(docs, limit=64, end_id=1).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for i, text, *_ in rows:
        ids = expected(text, 1)
        times = sum(r[0] == i and r[1] == text for r in rows)
        own = [r for r in pieces[i, len(ids)] if r.ids_crc32 == crc(ids[r.start : r.start + r.length])]
        assert sum(r.length for r in own) == times * len(ids)
        assert sorted(x for r in own for x in range(r.start, r.start + r.length)) == sorted(list(range(len(ids))) * times)
    assert sum(r.length for r in got) == sum(len(expected(t, 1)) for _, t, *_ in rows)
    assert sum(r.length for r in got) >= 0.9 * 64 * len(sequences)
    assert pack_documents(none).collect() == []


def test_token_counts(docs, rows, none):
    want = sorted((i or -1, len((t or "").encode()), len(expected(t, 1)) - 1) for i, t, *_ in rows)
    got = token_counts(docs, budget=50, table=True).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 50) and unpack_counts(r.prefix_counts)[-1] == r.n_tokens for r in got)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts(docs).collect()) == [(i, n) for i, _, n in want]
    assert token_counts(none).collect() == []


def test_cut_to_budget_equals_search():
    library, counter = load(tokenizer_path()), PrefixCounter(tokenizer_path())
    for text in ODD:
        for budget in (0, 1, 2, 5):
            fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= budget]
            assert cut_to_budget(text, counter.counts(text), budget) == text[: max(fits)]


def test_records_round_trip(spark, docs, rows, none):
    manifest = records.write_records(docs, shared_dir(spark, "test-records"))
    got = records.read_records(manifest, ids=True).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(e), crc(e)) for i, t, *_ in rows for e in [expected(t, 2)])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and crc(r.token_ids) == r.ids_crc32
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    file = manifest.orderBy("shard").first()
    ids = [records.read_at(file.path, k)[0] for k in range(file.records)]
    assert ids == [r.doc_id for r in sorted(got, key=lambda r: r.start)][: file.records]
    assert records.records_round_trip(none).collect() == []


def test_damaged_records_are_refused(tmp_path):
    import io

    good = records.framed(records.payload_of(7, np.array([1, 70000])))
    assert records.ids_of(records.read_record(io.BytesIO(good)))[1].tolist() == [1, 70000]
    assert records.read_record(io.BytesIO(b"")) is None
    for k in range(len(good)):
        bad = good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]
        with pytest.raises(ValueError):
            records.read_record(io.BytesIO(bad))
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(good[:-1]))
