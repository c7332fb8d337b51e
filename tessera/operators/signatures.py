"""Signatures: one table of tests over the files of a dataset, evaluated by kind.

A test is addressed to a role, or to none. Its window is an element of the role's layout, or given by its ends; an element
that floats is read in the frame of each single read. Every test gives a row for every file, also for one
without reads or without a read that could be measured."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import frames, predicates, reads as read_ops
from tessera.operators.frames import Layout

KINDS = ["segment_length", "has_segment", "distinct_ratio", "onlist_hit_rate", "motif_present", "base_composition", "header_index"]


@dataclass(frozen=True)
class Test:
    """A test of a signature. use: requires, excludes or supports. What the other fields mean depends on the kind.

    segment_length: length, tolerance, over_length. has_segment: segment (constant, random, polyT, polyA). distinct_ratio:
    expect (low, high). onlist_hit_rate: onlist, least, orientation, drift. motif_present: motif, where, start, end (of a window), mismatches, least.
    base_composition: base, least. header_index: present."""

    __test__ = False  # none of pytest's

    use: str
    kind: str
    role: str | None = None
    weight: float = 1.0
    element: str | None = None
    start: int | None = None
    end: int | None = None
    length: int = 0
    tolerance: int = 0
    over_length: int | None = None
    segment: str = "constant"
    expect: str = "low"
    onlist: str = ""
    orientation: str = "either"
    drift: int = 2
    motif: str = ""
    where: str = "anywhere"
    mismatches: int = 1
    base: str = "A"
    least: float = 0.5
    present: bool = True


@dataclass(frozen=True)
class Inputs:
    """What the tests read: reads (file, seq), files (file), name grammars (file, sra_normalized, index), and lists by name: (barcodes, width)."""

    reads: DataFrame
    files: DataFrame
    names: DataFrame | None = None
    onlists: dict[str, tuple[DataFrame, int]] | None = None


def _window(test: Test, layout: Layout) -> tuple[int, int | None]:
    if test.element is None:
        return test.start or 0, test.end
    found = [e for e in layout if e.name == test.element]
    return (found[0].start or 0, found[0].end) if found else (0, None)


def _floating(test: Test, layout: Layout) -> str | None:
    return next((e.name for e in layout if e.name == test.element and e.floats), None)


def _same(files: DataFrame, outcome: str, score: float, answerable: bool) -> DataFrame:
    return files.select("file", F.lit(outcome).alias("outcome"), F.lit(score).alias("score"), F.lit(answerable).alias("answerable"))


def _one(test: Test, layout: Layout, given: Inputs, cycles: DataFrame, modes: DataFrame) -> DataFrame:
    """file, outcome, score, answerable and, of list tests, admits: of files that could be measured, and of others where that is told from the whole."""
    start, end = _window(test, layout)
    floating = _floating(test, layout)
    if test.kind == "segment_length":
        return predicates.segment_length(modes, test.length, test.tolerance, test.over_length)
    if test.kind == "has_segment":
        if test.segment == "constant":
            return _same(given.files, "abstain", 0.0, False) if end is None else predicates.constant_segment(given.reads, start, end)
        if test.segment == "random":
            return predicates.random_segment(cycles, start, end)
        return predicates.homopolymer_segment(cycles, {"polyT": "T", "polyA": "A"}[test.segment], start, end)
    if test.kind == "base_composition":
        return predicates.base_composition(cycles, test.base, test.least, start, end)
    if test.kind == "distinct_ratio":
        if floating:
            return predicates.distinct_verdict(frames.anchored_distinct_ratio(given.reads, layout, floating), test.expect)
        return _same(given.files, "abstain", 0.0, False) if end is None else predicates.distinct_test(given.reads, start, end, test.expect)
    if test.kind == "motif_present":
        return predicates.motif_test(read_ops.motif_search(given.reads, test.motif, test.where, test.start or 0, test.end, test.mismatches), test.least)
    if test.kind == "header_index":
        return _same(given.files, "abstain", 0.0, False) if given.names is None else predicates.header_test(given.names, test.present)
    if test.onlist not in (given.onlists or {}):
        return _same(given.files, "abstain", 0.0, True)  # nobody could ask: unconfirmed, but not unanswerable
    onlist, width = given.onlists[test.onlist]
    if floating:
        hits = frames.anchored_hit_rate(given.reads, layout, floating, onlist, width, test.orientation)
    else:
        hits = read_ops.onlist_hit_rate(given.reads, onlist, start, width, test.drift, frames.STRANDS[test.orientation])
    hits = given.files.select("file").join(hits.select("file", "n", "hits"), "file", "left")
    return predicates.onlist_test(hits, onlist.agg(F.count_distinct("barcode").alias("entries")), width, test.least)


#: What a file says that gives no measurement: it fails a length, and a list; of all else it says nothing.
_UNMEASURED = {"segment_length": ("fail", True), "onlist_hit_rate": ("fail", True)}


def evaluate(tests: list[Test], layouts: dict[str, Layout], given: Inputs) -> DataFrame:
    """test (its number), role, kind, use, weight, low, high, file, outcome, score, answerable, admits: a row for every test and file.

    low and high are the bounds between which a failed length test is open to admission by a list. Tests that need the same
    statistics share them: cycles and length modes are stored by Spark's exchange reuse, once for all tests."""
    unknown = [t.kind for t in tests if t.kind not in KINDS]
    if unknown:
        raise ValueError(f"no such test: {', '.join(unknown)}")
    cycles = read_ops.per_cycle_composition(given.reads)
    modes = given.files.select("file").join(read_ops.read_length_profile(given.reads).select("file", "mode"), "file", "left")
    return reduce(DataFrame.unionByName, [_rows(k, t, _one(t, layouts.get(t.role, []), given, cycles, modes), given.files) for k, t in enumerate(tests)])


def _rows(number: int, test: Test, found: DataFrame, files: DataFrame) -> DataFrame:
    outcome, answerable = _UNMEASURED.get(test.kind, ("abstain", False))
    rows = files.select("file").join(found, "file", "left")
    over = test.kind == "segment_length" and test.over_length is not None
    text = lambda x: F.lit(x).cast("string")
    bound = lambda x: F.lit(x if over else None).cast("int")
    admits: Column = F.coalesce("admits", F.lit(False)) if "admits" in found.columns else F.lit(False)
    return rows.select(
        F.lit(number).alias("test"), text(test.role).alias("role"), text(test.kind).alias("kind"), text(test.use).alias("use"), F.lit(float(test.weight)).alias("weight"),
        bound(test.length).alias("low"), bound(test.over_length).alias("high"), "file", F.coalesce("outcome", F.lit(outcome)).alias("outcome"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("answerable", F.lit(answerable)).alias("answerable"), admits.alias("admits"),
    )
