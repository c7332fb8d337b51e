from __future__ import annotations

import gzip
import os

from tessera.sources import gzip_ends


def fastq(n):
    return "".join(f"@r{k}\nACGT{'A' * k}\n+\nFFFF{'F' * k}\n" for k in range(n)).encode()


def test_both_ends(spark, tmp_path):
    gzip_ends.register(spark)
    noise = os.urandom(200_000)
    files = {
        "a": gzip.compress(fastq(5)), "b": gzip.compress(fastq(3)) + gzip.compress(fastq(4)), "c": gzip.compress(fastq(50))[:-30], "d": gzip.compress(noise),
        "e": gzip.compress(fastq(2)) + b"garbage behind it", "f": b"", "g": b"no", "h": b"no gzip at all", "i": gzip.compress(b""),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.gz").write_bytes(data)
    rows = spark.read.format("gzip_ends").option("prefixBytes", 4096).option("maxBytes", 100_000).load(str(tmp_path))
    got = {os.path.basename(r.file)[0]: r for r in rows.collect()}
    assert {k: r.size_bytes for k, r in got.items()} == {k: len(v) for k, v in files.items()}
    assert got["a"].isize == len(fastq(5)) and bytes(got["a"].prefix) == fastq(5) and (got["a"].cut, got["a"].ok) == (False, True)
    assert got["b"].isize == len(fastq(4)) and bytes(got["b"].prefix) == fastq(3) + fastq(4) and not got["b"].cut
    assert fastq(50).startswith(bytes(got["c"].prefix)) and (got["c"].cut, got["c"].ok) == (True, True)
    assert got["d"].isize == 200_000 and got["d"].compressed_read == 4096 and noise.startswith(bytes(got["d"].prefix)) and got["d"].cut
    assert not got["e"].ok and bytes(got["e"].prefix) == fastq(2) and not got["h"].ok and got["f"].isize is None and got["g"].isize is None
    assert (bytes(got["i"].prefix), got["i"].isize, got["i"].cut, got["i"].ok) == (b"", 0, False, True)
    few = spark.read.format("gzip_ends").option("maxBytes", 40).load(str(tmp_path / "a.gz")).first()
    assert bytes(few.prefix) == fastq(5)[:40] and few.cut
    records = {os.path.basename(r.file)[0]: [tuple(x) for x in r.records] for r in gzip_ends.prefix_records(rows, 6).collect()}
    assert records["a"] == [(f"@r{k}", 4 + k) for k in range(5)]
    assert len(records["b"]) == 6 and records["f"] == records["i"] == []
    whole = bytes(got["c"].prefix).decode()
    assert records["c"] == [(f"@r{k}", 4 + k) for k in range(min(6, whole.count("\n") // 4))]


def test_sizes_wrap():
    data, cut, ok = gzip_ends.inflated(gzip.compress(b"x" * 100), 10)
    assert (data, cut, ok) == (b"x" * 10, True, True)
