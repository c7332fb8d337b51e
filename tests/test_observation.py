from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import observation
from tessera.operators.reads import per_cycle_composition, segments

READS = [("f", "AAAAACGT"), ("f", "AAAAATGN"), ("f", "AAAAAGCA"), ("f", "AAAAA"), ("f", ""), ("f", None), ("e", ""), ("n", "NN")]


def test_one_observation_per_file(spark):
    rows = spark.createDataFrame(READS, "file string, seq string")
    got = {r.file: r for r in observation.observations(rows).collect()}
    assert (got["f"].n_reads, got["f"].mode_length, got["f"].least_length, got["f"].most_length, got["f"].n_cycles) == (5, 8, 0, 8, 8)
    reached, called = 8 * 3 + 5, 8 * 3 + 5 - 1
    assert got["f"].reach == round(reached / 40, 9) and got["f"].called == round(called / reached, 9)
    parts = [(s.start, s.end, s.kind, s.bases, s.coverage) for s in got["f"].segments]
    assert parts[0] == (0, 5, "homopolymer", "AAAAA", 0.8) and [p[:2] for p in parts] == [(0, 5), (5, 8)]
    assert parts[1][2:] == ("random", None, round(8 / 15, 9))
    assert [tuple(w) for w in got["f"].windows] == [(5, 8, 3, 1.0)]
    assert (got["e"].n_reads, got["e"].n_cycles, got["e"].reach, got["e"].called, got["e"].segments, got["e"].windows) == (1, 0, 0.0, 0.0, None, None)
    assert (got["n"].n_reads, got["n"].reach, got["n"].called) == (1, 1.0, 0.0)
    assert observation.observations(rows.limit(0)).collect() == []


def test_ratios_equal_those_of_single_windows(spark):
    rows = spark.createDataFrame([("f", "ACGT" * 3), ("f", "ACGA" * 3), ("f", "ACGT" * 3), ("f", "AC")], "file string, seq string")
    spans = spark.createDataFrame([("f", 0, 4), ("f", 2, 12), ("f", 5, 40)], "file string, start long, end long")
    got = {(r.start, r.end): (r.n, r.ratio) for r in observation.distinct_ratios(rows, spans).collect()}
    reads = [s for _, s in [tuple(r) for r in rows.collect()]]
    want = {}
    for a, b in ((0, 4), (2, 12)):
        cut = Counter(s[a:b] for s in reads if len(s) >= b)
        want[a, b] = (sum(cut.values()), len(cut) / sum(cut.values()))
    assert got == want
    cycles = per_cycle_composition(rows)
    sizes = spark.createDataFrame([("f", 4)], "file string, n_reads long")
    spanned = observation.span_coverage(cycles, segments(cycles), sizes).collect()
    assert all(0 < r.coverage <= 1 for r in spanned)


def test_estimated_totals(spark):
    cases = [(0, 9, 9, 9, True, 9, 0, "compressed_ratio"), (7, 100, 50, 10, False, 500, 7, "isize"), (10, 100, 50, 10, True, 500, 100, "isize"), (10, 100, 50, 10, True, 40, 100, "compressed_ratio"), (10, 100, 50, 0, True, None, 10, "compressed_ratio")]
    rows = spark.createDataFrame([(k, *c[:6]) for k, c in enumerate(cases)], "k int, n long, size long, d long, c long, x boolean, i long")
    got = rows.select("k", observation.estimated_reads(*(F.col(c) for c in ("n", "size", "d", "c", "x", "i"))).alias("e")).collect()
    assert {r.k: tuple(r.e) for r in got} == {k: c[6:] for k, c in enumerate(cases)}
