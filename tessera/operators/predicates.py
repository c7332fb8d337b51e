"""Signature tests of read files, and the cells and sets that are scored with them.

A test gives one row per file: outcome (pass, fail or abstain), score from 0 to 1, answerable.
What the bytes are silent about abstains with score 0 and is not answerable: it never gates
and leaves the normaliser. All statistics are groupings over reads; verdicts are per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.reads import consensus_match_rate, distinct_ratio

#: The share of reads that carry a constant window, mismatches a base that it may have, the largest mean share of one base in a random window, and the share of one base in a homopolymer.
CARRIERS, MISMATCHES, RANDOM_MOST, HOMOPOLYMER_LEAST = 0.5, 0.1, 0.55, 0.8
#: An over-long read is admitted from this hit rate on, if it is so many times the rate by chance.
ADMITTED_RATE, ADMITTED_TIMES = 0.05, 50.0
DIGITS = 9


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _evaluation(file: str, measured: Column, passes: Column, score: Column) -> list[Column | str]:
    """file, outcome, score, answerable; nothing measured is nothing answered."""
    outcome = F.when(measured.isNull(), "abstain").when(passes, "pass").otherwise("fail")
    return [file, outcome.alias("outcome"), F.round(F.when(measured.isNull(), 0.0).otherwise(score), DIGITS).alias("score"), measured.isNotNull().alias("answerable")]


def segment_length(profile: DataFrame, length: int, tolerance: int = 0, over_length: int | None = None) -> DataFrame:
    """The mode length of files (file, mode) against a declared one: exact within ``tolerance``, or at least ``over_length``; the score falls linearly over a tenth of it."""
    over = F.lit(False) if over_length is None else F.col("mode") >= over_length
    mode = F.coalesce(F.col("mode"), F.lit(0))
    off = F.abs(mode - length)
    score = F.when(mode == 0, 0.0).when(over, 1.0).otherwise(clipped(1 - off / max(1.0, length * 0.1)))
    return profile.select(*_evaluation("file", mode, (mode > 0) & (over | (off <= tolerance)), score))


def read_length_compatible(profile: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """file, compatible: whether the mode length of a file (file, mode) can fill a role of these lengths; an empty file cannot."""
    mode = F.coalesce(F.col("mode"), F.lit(0))
    fits = (mode > 0) & (F.lit(True) if least is None else mode >= least) & (F.lit(True) if most is None else mode <= most)
    return profile.select("file", fits.alias("compatible"))


def constant_segment(reads: DataFrame, start: int, end: int) -> DataFrame:
    """Whether most reads of a file (file, seq) carry the window's modal sequence, within a tenth of its bases."""
    rates = consensus_match_rate(reads, start, end, int((end - start) * MISMATCHES)).select("file", "rate")
    rate = F.col("rate")
    return reads.select("file").distinct().join(rates, "file", "left").select(*_evaluation("file", rate, rate >= CARRIERS, clipped(rate / CARRIERS)))


def _window(cycles: DataFrame, start: int, end: int | None, share: Column) -> DataFrame:
    """file, share: the mean over cycles [start, end) of a share; null for files that reach none. cycles: as per_cycle_composition gives them."""
    inside = (F.col("cycle") >= start) & (F.lit(True) if end is None else F.col("cycle") < end)
    return cycles.groupBy("file").agg(F.avg(F.when(inside, share)).alias("share"))


def random_segment(cycles: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Whether the window's cycles have no base of their own, on average."""
    share = F.greatest("n_a", "n_c", "n_g", "n_t") / F.col("n")
    mean = F.col("share")
    return _window(cycles, start, end, share).select(*_evaluation("file", mean, mean <= RANDOM_MOST, clipped((RANDOM_MOST - mean) / 0.3)))


def base_composition(cycles: DataFrame, base: str, least: float, start: int = 0, end: int | None = None) -> DataFrame:
    """Whether the mean share of one base (A, C, G, T or N) over the window's cycles is ``least`` or more."""
    mean = F.col("share")
    rows = _window(cycles, start, end, F.col(f"n_{base.lower()}") / F.col("n"))
    return rows.select(*_evaluation("file", mean, mean >= least, clipped(mean / max(least, 1e-9))))


def homopolymer_segment(cycles: DataFrame, base: str, start: int, end: int | None = None) -> DataFrame:
    """Whether the window is a run of one base: its score is the mean share itself."""
    mean = F.col("share")
    rows = _window(cycles, start, end, F.col(f"n_{base.lower()}") / F.col("n"))
    return rows.select(*_evaluation("file", mean, mean >= HOMOPOLYMER_LEAST, clipped(mean)))


def distinct_test(reads: DataFrame, start: int, end: int, expect: str) -> DataFrame:
    """Distinct windows by windows, expected low or high."""
    return distinct_verdict(distinct_ratio(reads, start, end), expect)


def distinct_verdict(ratios: DataFrame, expect: str) -> DataFrame:
    """Files' ratios (file, ratio) against an expectation: depends on depth, so it scores but always abstains."""
    ratio = F.col("ratio")
    rows = ratios.select(*_evaluation("file", ratio, F.lit(True), clipped(1 - ratio if expect == "low" else ratio)))
    return rows.withColumn("outcome", F.lit("abstain"))


def motif_test(rates: DataFrame, least: float) -> DataFrame:
    """Whether the share of reads with a motif (file, rate; null if no read could carry it) is ``least`` or more."""
    rate = F.col("rate")
    return rates.select(*_evaluation("file", rate, rate >= least, clipped(rate / max(least, 1e-9))))


def onlist_test(hits: DataFrame, entries: DataFrame, width: int, least: float) -> DataFrame:
    """Files' best hit rates (file, n, hits) in a list: the score rises from the rate by chance to ``least``.

    entries: one row with the list's size as ``entries``. Adds admits: far enough above chance to
    admit an over-long read."""
    rate = F.coalesce(F.try_divide("hits", "n"), F.lit(0.0))
    floor = F.col("entries") / 4.0**width
    score = F.when(floor >= least, (rate >= least).cast("double")).otherwise(clipped((rate - floor) / (F.lit(least) - floor)))
    rows = hits.join(F.broadcast(entries))
    return rows.select(*_evaluation("file", rate, rate >= least, score), (rate >= F.greatest(F.lit(ADMITTED_RATE), floor * ADMITTED_TIMES)).alias("admits"))


def header_test(names: DataFrame, present: bool) -> DataFrame:
    """Whether a file's read names (file, sra_normalized, index) carry an index; names that an archive has rewritten say nothing."""
    has = F.when(~F.col("sra_normalized"), F.col("index").isNotNull())
    return names.select(*_evaluation("file", has, has == present, (has == present).cast("double")))


def score_cells(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell (``keys``: such as dataset, spec, role, file) of tests (use, outcome, score, answerable, weight): forbidden, reason, value.

    use: requires, excludes, or supports with a weight. A failed requirement or a matched
    exclusion forbids a cell; its value is the weighted mean of its answered supports, 0 without."""
    counts = F.when((F.col("use") == "supports") & F.col("answerable"), F.col("weight"))
    failed = F.count_if((F.col("use") == "requires") & (F.col("outcome") == "fail"))
    matched = F.count_if((F.col("use") == "excludes") & (F.col("outcome") == "pass"))
    by = evaluations.groupBy(*keys).agg(failed.alias("failed"), matched.alias("matched"), F.sum(counts * F.col("score")).alias("s"), F.sum(counts).alias("w"))
    forbidden = (F.col("failed") > 0) | (F.col("matched") > 0)
    reason = F.when(F.col("failed") > 0, "requires").when(F.col("matched") > 0, "excludes").otherwise("scored")
    return by.select(*keys, forbidden.alias("forbidden"), reason.alias("reason"), F.when(forbidden, 0.0).otherwise(F.round(F.coalesce(F.try_divide("s", "w"), F.lit(0.0)), DIGITS)).alias("value"))


def best_read_sets(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the read set (read_set, value; null: forbidden, n_roles) of most value, then of most roles, then the first by name."""
    order = F.struct(F.coalesce("value", F.lit(float("-inf"))).alias("value"), F.col("n_roles").alias("n_roles"))
    best = evaluations.groupBy(*keys).agg(F.max(order).alias("top"))
    rows = evaluations.join(best, keys).where(order == F.col("top"))
    return rows.groupBy(*keys).agg(F.min("read_set").alias("read_set"), F.first("value").alias("value"), F.first("n_roles").alias("n_roles"))


