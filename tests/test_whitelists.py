from __future__ import annotations

import gzip
import hashlib
import random

import numpy as np
import pytest

from tessera.sources import whitelists


def drawn(seed, width, n):
    rng = random.Random(seed)
    some = ["".join(rng.choice("ACGT") for _ in range(width)) for _ in range(n)]
    return [*some, "A" * width, "T" * width, "G" + "C" * (width - 1)]


def coded(barcodes, kind):
    return np.array(sorted({int(b.translate(str.maketrans("ACGT", "0123")), 4) for b in barcodes}), kind)


@pytest.mark.parametrize("width", [8, 16, 32])
def test_round_trip_and_identity(spark, width):
    own = drawn(width, width, 700)
    more = ["A" * (width - 1) + "N", "", None, "ACG", "a" * width, *own[:50]]
    rows = spark.createDataFrame([(b,) for b in own + more], "barcode string")
    parts = whitelists.encode(rows.repartition(7), width, piece_size=64)
    held = parts.orderBy("part").collect()
    want = coded(own, whitelists.code_type(width))
    assert len(held) > 1 and [r.part for r in held] == list(range(len(held))) and sum(r.n for r in held) == len(want)
    # the pieces on end are one file of differences
    steps = np.frombuffer(gzip.decompress(b"".join(bytes(r.data) for r in held)), want.dtype)
    assert np.array_equal(np.cumsum(steps, dtype=want.dtype), want)
    back = [r.barcode for r in whitelists.decode(parts, width).collect()]
    assert sorted(back) == sorted(set(own))
    found = whitelists.set_identity(rows, width).first()
    assert (found.n, found.sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
    assert whitelists.set_identity(spark.createDataFrame([(b,) for b in reversed(own)], "barcode string"), width).first().sha256 == found.sha256


def test_empty_lists_and_widths(spark):
    none = spark.createDataFrame([(None,)], "barcode string")
    assert whitelists.encode(none, 8).collect() == []
    assert whitelists.decode(whitelists.encode(none, 8), 8).collect() == []
    assert tuple(whitelists.set_identity(none, 8).first()) == (0, hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError, match="33"):
        whitelists.codes(none, 33)


def test_text(spark, tmp_path):
    rows = spark.createDataFrame([("ACGT",), ("AAAA",), ("ACGT",), (None,)], "barcode string")
    whitelists.write_whitelist_text(rows, str(tmp_path / "w"))
    assert [r.barcode for r in whitelists.read_whitelist(spark, str(tmp_path / "w")).collect()] == ["AAAA", "ACGT"]
    with gzip.open(tmp_path / "l.txt.gz", "wt") as f:
        f.write(" ACGT \n\nTTTT")
    assert [r.barcode for r in whitelists.read_whitelist(spark, str(tmp_path / "l.txt.gz")).collect()] == ["ACGT", "TTTT"]
