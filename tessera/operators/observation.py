"""One observation per file: everything its sampled reads tell, from one table of reads.

The reads (a bounded head of each file) are walked once for their cycles and once for the windows that the cycles show; all other
signals are of those two small tables. No signal scans the reads for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.reads import per_cycle_composition, segments


def _called(cycles: DataFrame) -> Column:
    return F.col("n") - F.col("n_n")


def head_coverage(cycles: DataFrame, sizes: DataFrame) -> DataFrame:
    """file, reach, called: the share of (read, cycle) cells that reads reach, and of those the share with a called base; 0 without any.

    cycles: as per_cycle_composition gives them. sizes: file, n_reads."""
    by = cycles.groupBy("file").agg(F.count("*").alias("n_cycles"), F.sum("n").alias("reached"), F.sum(_called(cycles)).alias("called"))
    rows = sizes.join(by, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("file", zero(F.try_divide("reached", F.col("n_reads") * F.col("n_cycles"))).alias("reach"), zero(F.try_divide("called", "reached")).alias("called"))


def span_coverage(cycles: DataFrame, spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """The spans (file, start, end and others) with coverage: the share of (read, cycle) cells in [start, end) with a called base."""
    called = cycles.select("file", "cycle", _called(cycles).alias("called"))
    inside = spans.join(called, "file").where((F.col("cycle") >= F.col("start")) & (F.col("cycle") < F.col("end")))
    by = inside.groupBy("file", "start", "end").agg(F.sum("called").alias("called"))
    rows = spans.join(by, ["file", "start", "end"], "left").join(sizes, "file")
    possible = F.col("n_reads") * (F.col("end") - F.col("start"))
    return rows.withColumn("coverage", F.coalesce(F.try_divide("called", possible), F.lit(0.0))).drop("called", "n_reads")


def distinct_ratios(reads: DataFrame, spans: DataFrame) -> DataFrame:
    """file, start, end, n, ratio of random spans: distinct windows by windows; spans that no read holds have no row.

    spans: file, start, end, a few of each file; one pass over the reads for all of them."""
    held = reads.select("file", "seq").join(F.broadcast(spans.select("file", "start", "end")), "file").where(F.length("seq") >= F.col("end"))
    window = F.substring(F.col("seq"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    distinct = held.groupBy("file", "start", "end", window.alias("w")).count()  # before they are counted apart
    return distinct.groupBy("file", "start", "end").agg(F.sum("count").alias("n"), (F.count("*") / F.sum("count")).alias("ratio"))


def estimated_reads(n_reads: Column, file_size: Column, decompressed: Column, compressed: Column, exhausted: Column, isize: Column) -> Column:
    """struct(total, method): how many reads a file holds, from a head of it.

    Read to its end the count is exact. Else by the uncompressed size that the gzip trailer states, if it is more than was read; else by compressed sizes."""
    exact = F.struct(n_reads.cast("long").alias("total"), F.lit("isize").alias("method"))
    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit("compressed_ratio").alias("method"))
    trailer = F.struct(F.floor(isize / (decompressed / n_reads)).cast("long").alias("total"), F.lit("isize").alias("method"))
    ratio = F.struct(F.when(compressed > 0, F.floor(file_size * n_reads / compressed)).otherwise(n_reads).cast("long").alias("total"), F.lit("compressed_ratio").alias("method"))
    return F.when(n_reads == 0, none).when(~exhausted, exact).when(isize.isNotNull() & (decompressed > 0) & (isize > decompressed), trailer).otherwise(ratio)


def observations(reads: DataFrame) -> DataFrame:
    """Per file of reads (file, seq): n_reads, mode_length, least_length, most_length, n_cycles, reach, called, segments, windows.

    segments: structs of start, end, kind, bases, coverage, in order; windows: structs of start, end, n, ratio of the random ones. An
    empty read counts in n_reads, a null one is none. The reads should be a stored table or file: they are read twice."""
    reads = reads.where("seq is not null")
    lengths = reads.groupBy("file", F.length("seq").alias("length")).count()  # a row for each length
    sizes = lengths.groupBy("file").agg(F.sum("count").alias("n_reads"), F.min("length").alias("least_length"), F.max("length").alias("most_length"), F.max_by("length", F.struct("count", -F.col("length"))).alias("mode_length"))
    cycles = per_cycle_composition(reads)
    spans = span_coverage(cycles, segments(cycles), sizes.select("file", "n_reads"))
    held = F.array_sort(F.collect_list(F.struct("start", "end", "kind", "bases", F.round("coverage", 9).alias("coverage"))))
    windows = distinct_ratios(reads, spans.where("kind = 'random'"))
    cut = F.array_sort(F.collect_list(F.struct("start", "end", "n", F.round("ratio", 9).alias("ratio"))))
    rows = sizes.join(head_coverage(cycles, sizes), "file").join(cycles.groupBy("file").agg(F.count("*").cast("int").alias("n_cycles")), "file", "left")
    rows = rows.join(spans.groupBy("file").agg(held.alias("segments")), "file", "left").join(windows.groupBy("file").agg(cut.alias("windows")), "file", "left")
    return rows.select("file", "n_reads", "mode_length", "least_length", "most_length", F.coalesce("n_cycles", F.lit(0)).alias("n_cycles"), F.round("reach", 9).alias("reach"), F.round("called", 9).alias("called"), "segments", "windows")
