"""Half-open intervals by contig: rows of (contig, start, end) and what they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(intervals: DataFrame, gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap or lie within ``gap`` of each other; empty ones are left out.

    contig, start, end, n. Runs are found inside blocks of starts first, so that one contig's
    intervals need not meet in a task until few are left."""
    rows = intervals.where("start < end").select("contig", "start", "end", F.lit(1).cast("long").alias("n"))
    rows = rows.groupBy("contig", "start").agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    return _runs(_runs(rows.withColumn("block", F.pmod(F.floor(F.col("start") / (1 << 20)), F.lit(1 << 12))), gap, ["contig", "block"]), gap, ["contig"]).select("contig", "start", "end", "n")


def _runs(rows: DataFrame, gap: int, by: list[str]) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy("start", "end")
    new = F.when(F.col("start") > F.max("end").over(before) + gap, 1).otherwise(0)
    rows = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    return rows.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__run")


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of intervals of one contig that share a place; columns of ``right`` get the prefix r_.

    Both sides are dealt over bins of ``width``, and a pair is made in the bin where the later
    of both starts: an equi-join without duplicates. Adjacent intervals share nothing, empty
    ones cover nothing. ``width`` should be near the usual length."""
    right = right.select(F.col("contig"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != "contig"))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    a = left.where("start < end").withColumn("__bin", bins("start", "end"))
    b = right.where("r_start < r_end").withColumn("__bin", bins("r_start", "r_end"))
    meet = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    once = F.col("__bin") == F.floor(F.greatest("start", "r_start") / width)
    return a.join(b, ["contig", "__bin"]).where(meet & once).drop("__bin")


def coverage_steps(intervals: DataFrame, block: int = 1 << 20) -> DataFrame:
    """A sweep over starts and ends: contig, start, end, depth of every stretch covered at least once.

    Each block of places is swept by itself, from the depth and to the place that its contig's
    other blocks hand over: only one row a block is ordered by contig."""
    rows = intervals.where("start < end")
    events = rows.select("contig", F.col("start").alias("at"), F.lit(1).alias("d")).union(rows.select("contig", F.col("end").alias("at"), F.lit(-1).alias("d")))
    events = events.groupBy("contig", "at").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("block", F.floor(F.col("at") / block))
    blocks = events.groupBy("contig", "block").agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    by = Window.partitionBy("contig").orderBy("block")
    carried = F.coalesce(F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("contig", "block", carried.alias("carried"), F.lead("first").over(by).alias("next"))
    order = Window.partitionBy("contig", "block").orderBy("at")
    steps = events.select("contig", "block", F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("d").over(order).alias("depth"))
    steps = steps.join(blocks, ["contig", "block"])
    return steps.select("contig", "start", F.coalesce("end", "next").alias("end"), (F.col("depth") + F.col("carried")).alias("depth")).where("depth > 0")


def active_sets(intervals: DataFrame, width: int) -> DataFrame:
    """contig, start, end, genes: every stretch between two ends of (contig, start, end, gene) and the sorted genes over it, commas between."""
    rows = intervals.where("start < end").select("contig", "start", "end", "gene")
    ends = rows.select("contig", F.explode(F.array("start", "end")).alias("start")).distinct().withColumn("block", F.floor(F.col("start") / (1 << 20)))
    by = Window.partitionBy("contig").orderBy("block")
    blocks = ends.groupBy("contig", "block").agg(F.min("start").alias("first")).select("contig", "block", F.lead("first").over(by).alias("next"))
    step = F.lead("start").over(Window.partitionBy("contig", "block").orderBy("start"))
    steps = ends.withColumn("end", step).join(blocks, ["contig", "block"]).select("contig", "start", F.coalesce("end", "next").alias("end")).where("end is not null")
    over = overlaps(steps, rows, width).groupBy("contig", "start", "end")
    return over.agg(F.array_join(F.array_sort(F.collect_set(F.col("r_gene").cast("string"))), ",").alias("genes"))


def clean_introns(exons: DataFrame, least: int, width: int) -> DataFrame:
    """contig, gene, start, end: gaps of ``least`` or more between a gene's merged exons that no exon reaches into and no other gene spans.

    exons: contig, start, end, gene, half-open."""
    parts = merged(exons.select(F.struct("contig", "gene").alias("contig"), "start", "end")).select("contig.contig", "contig.gene", "start", "end")
    gaps = parts.select("contig", "gene", F.col("end").alias("start"), F.lead("start").over(Window.partitionBy("contig", "gene").orderBy("start")).alias("end"))
    gaps = gaps.where(F.col("end") - F.col("start") >= least)
    spans = parts.groupBy("contig", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    keys = ["contig", "gene", "start", "end"]
    hit = overlaps(gaps, parts.select("contig", "start", "end"), width).select(keys).distinct()
    shared = overlaps(gaps, spans, width).where("gene <> r_gene").select(keys).distinct()
    return gaps.join(hit, keys, "left_anti").join(shared, keys, "left_anti")


def fragment_fates(fragments: DataFrame, exons: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """fragment, fate, gene: the first that holds of unmapped, multimapping (hits > 1), exonic (one
    gene's exons), ambiguous (several genes' exons), intronic (one gene's body), ambiguous
    (several bodies), no_feature.

    fragments: fragment, contig, start, end, hits (null: unmapped). exons, bodies: contig, start, end, gene."""
    mapped = fragments.where("hits = 1").select("fragment", "contig", "start", "end")
    genes = lambda table, name: overlaps(mapped, table.select("contig", "start", "end", "gene"), width).groupBy("fragment").agg(F.count_distinct("r_gene").alias(f"n_{name}"), F.min("r_gene").alias(name))
    rows = fragments.select("fragment", "hits").join(genes(exons, "exon"), "fragment", "left").join(genes(bodies, "body"), "fragment", "left")
    fate = (
        F.when(F.col("hits").isNull(), "unmapped").when(F.col("hits") > 1, "multimapping").when(F.col("n_exon") == 1, "exonic").when(F.col("n_exon") > 1, "ambiguous")
        .when(F.col("n_body") == 1, "intronic").when(F.col("n_body") > 1, "ambiguous").otherwise("no_feature")
    )
    rows = rows.withColumn("fate", fate)
    return rows.select("fragment", "fate", F.when(F.col("fate") == "exonic", F.col("exon")).when(F.col("fate") == "intronic", F.col("body")).alias("gene"))


def fragment_totals(fragments: DataFrame) -> DataFrame:
    """Of (barcode, reads): fragments, distinct barcodes, reads (a missing or odd count is 1), most and fewest fragments of a barcode."""
    reads = F.when(F.col("reads").rlike(r"^\d+$"), F.col("reads").try_cast("long")).otherwise(F.lit(1))
    by = fragments.select("barcode", F.coalesce(reads, F.lit(1)).alias("reads")).groupBy("barcode").agg(F.count("*").alias("n"), F.sum("reads").alias("reads"))
    out = by.agg(F.sum("n").alias("n_fragments"), F.count("*").alias("n_barcodes"), F.sum("reads").alias("n_reads"), F.max("n").alias("max_per_barcode"), F.min("n").alias("min_per_barcode"))
    return out.withColumn("reads_per_fragment", F.try_divide("n_reads", "n_fragments")).withColumn("fragments_per_barcode", F.try_divide("n_fragments", "n_barcodes"))
