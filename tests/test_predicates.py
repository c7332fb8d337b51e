"""Signature tests on small files: what is silent abstains, gates and scores keep apart."""

from __future__ import annotations

from tessera.operators import predicates as ops
from tessera.operators import reads as read_ops


def rows(df):
    return {r.file: (r.outcome, round(r.score, 6), r.answerable) for r in df.collect()}


def test_lengths(spark):
    profile = spark.createDataFrame([("a", 28), ("b", 27), ("c", 26), ("d", 91), ("e", 0), ("f", None)], "file string, mode int")
    assert rows(ops.segment_length(profile, 28)) == {"a": ("pass", 1.0, True), "b": ("fail", round(1 - 1 / 2.8, 6), True), "c": ("fail", round(1 - 2 / 2.8, 6), True), "d": ("fail", 0.0, True), "e": ("fail", 0.0, True), "f": ("fail", 0.0, True)}
    assert rows(ops.segment_length(profile, 28, 1, 50))["d"] == ("pass", 1.0, True)
    assert {r.file for r in ops.read_length_compatible(profile, 27, 90).where("compatible").collect()} == {"a", "b"}
    assert {r.file for r in ops.read_length_compatible(profile, None, None).where("not compatible").collect()} == {"e", "f"}


def test_windows(spark):
    seqs = ["ACGTTTTT"] * 6 + ["ACGATTTT"] * 2 + ["GGCCTTTT"] * 2 + ["AC"]
    reads = spark.createDataFrame([("f", s) for s in seqs] + [("g", "AC"), ("h", None)], "file string, seq string")
    assert rows(ops.constant_segment(reads, 0, 4)) == {"f": ("pass", 1.0, True), "g": ("abstain", 0.0, False), "h": ("abstain", 0.0, False)}
    cycles = read_ops.per_cycle_composition(reads)
    assert rows(ops.homopolymer_segment(cycles, "T", 4, 8)) == {"f": ("pass", 1.0, True), "g": ("abstain", 0.0, False)}
    assert rows(ops.base_composition(cycles, "A", 0.9, 0, 1))["f"] == ("fail", round(9 / 11 / 0.9, 6), True)
    assert rows(ops.random_segment(cycles, 0, 4))["f"][0] == "fail"
    assert rows(ops.distinct_test(reads, 0, 4, "high"))["f"] == ("abstain", 0.3, True)
    assert rows(ops.distinct_test(reads, 0, 4, "low"))["g"] == ("abstain", 0.0, False)


def test_lists_motifs_and_headers(spark):
    rates = spark.createDataFrame([("a", 0.4), ("b", 0.9), ("c", None)], "file string, rate double")
    assert rows(ops.motif_test(rates, 0.8)) == {"a": ("fail", 0.5, True), "b": ("pass", 1.0, True), "c": ("abstain", 0.0, False)}
    hits = spark.createDataFrame([("a", 100, 3), ("b", 100, 60), ("c", 0, 0), ("d", 100, 20)], "file string, n long, hits long")
    found = ops.onlist_test(hits, spark.createDataFrame([(16,)], "entries long"), 4, 0.6)
    floor = 16 / 256
    assert rows(found) == {"a": ("fail", 0.0, True), "b": ("pass", 1.0, True), "c": ("fail", 0.0, True), "d": ("fail", round((0.2 - floor) / (0.6 - floor), 6), True)}
    wide = ops.onlist_test(hits, spark.createDataFrame([(16,)], "entries long"), 8, 0.6)
    assert {r.file for r in wide.where("admits").collect()} == {"b", "d"}
    names = spark.createDataFrame([("a", False, "ACGTAC"), ("b", False, None), ("c", True, None)], "file string, sra_normalized boolean, index string")
    assert rows(ops.header_test(names, True)) == {"a": ("pass", 1.0, True), "b": ("fail", 0.0, True), "c": ("abstain", 0.0, False)}
    assert rows(ops.header_test(names, False))["b"] == ("pass", 1.0, True)


def test_cells_and_sets(spark):
    tests = [("x", "supports", "pass", 0.5, True, 2.0), ("x", "supports", "fail", 1.0, True, 1.0), ("x", "supports", "abstain", 0.0, False, 9.0), ("y", "requires", "fail", 0.0, True, None), ("y", "excludes", "pass", 1.0, True, None)]
    tests += [("z", "excludes", "pass", 1.0, True, None), ("v", "requires", "abstain", 0.0, False, None)]
    cells = ops.score_cells(spark.createDataFrame(tests, "cell string, use string, outcome string, score double, answerable boolean, weight double"), ["cell"])
    assert sorted(tuple(r) for r in cells.collect()) == [("v", False, "scored", 0.0), ("x", False, "scored", 0.666666667), ("y", True, "requires", 0.0), ("z", True, "excludes", 0.0)]
    sets = [("a", "whole", None, 2), ("a", "part", 0.1, 1), ("b", "whole", 0.5, 2), ("b", "part", 0.5, 1), ("c", "whole", None, 2), ("c", "part", None, 1)]
    best = ops.best_read_sets(spark.createDataFrame(sets, "key string, read_set string, value double, n_roles long"), ["key"])
    assert sorted((r.key, r.read_set) for r in best.collect()) == [("a", "part"), ("b", "whole"), ("c", "whole")]
