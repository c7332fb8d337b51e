"""Positional statistics of reads: rows of (file, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import BASES, dominant, entropy_bits, hamming, motif_found, motif_mismatches, reverse_complement, tag_match, window

PURE = 0.9  # share of one base from which a cycle counts as pure
HOMOPOLYMER = 4  # cycles of one base in a row


def per_cycle_composition(reads: DataFrame) -> DataFrame:
    """file, cycle, n (reads that reach the cycle), n_a, n_c, n_g, n_t and n_n (all else)."""
    cells = reads.where(F.length("seq") > 0).select("file", F.posexplode(F.split("seq", "")).alias("cycle", "base"))
    counts = [F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in BASES]
    other = F.count_if(~F.col("base").isin(*BASES)).alias("n_n")
    return cells.groupBy("file", F.col("cycle").cast("long").alias("cycle")).agg(F.count("*").alias("n"), *counts, other)


def cycle_profile(cycles: DataFrame) -> DataFrame:
    """Dominant base and entropy of each cycle, over called bases only."""
    counts = {b: F.col(f"n_{b.lower()}") for b in BASES}
    return cycles.select("file", "cycle", dominant(counts).alias("base"), F.round(entropy_bits(list(counts.values())), 9).alias("bits"))


def head_coverage(cycles: DataFrame) -> DataFrame:
    """Per file: reach (share of cells that reads reach) and called (share of those with a called base)."""
    by = cycles.groupBy("file").agg(F.sum("n").alias("reached"), F.max("n").alias("reads"), F.count("*").alias("cycles"), F.sum("n_n").alias("uncalled"))
    return by.select("file", (F.col("reached") / (F.col("reads") * F.col("cycles"))).alias("reach"), ((F.col("reached") - F.col("uncalled")) / F.col("reached")).alias("called"))


def read_length_profile(reads: DataFrame) -> DataFrame:
    """Per file: mode (the smallest of tied lengths), its share, distinct, least, most, p1, p50, p99 (null for one length).

    Percentiles are taken by rank from running counts of lengths, so no task gathers reads."""
    lengths = reads.groupBy("file", F.length("seq").alias("length")).count()
    up = Window.partitionBy("file").orderBy("length")
    ranked = lengths.withColumn("upto", F.sum("count").over(up))
    by = ranked.groupBy("file").agg(
        F.max_by("length", F.struct("count", -F.col("length"))).alias("mode"), F.max("count").alias("most_common"), F.sum("count").alias("n"),
        F.count("*").alias("n_distinct"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.array_sort(F.collect_list(F.struct("upto", "length"))).alias("steps"),
    )

    def at(rank: Column) -> Column:
        first = F.element_at(F.filter("steps", lambda s: s.upto > rank), 1).length
        return F.when(F.col("n_distinct") > 1, first)

    n = F.col("n")
    return by.select(
        "file", "mode", (F.col("most_common") / n).alias("mode_share"), "n_distinct", "min_length", "max_length",
        at(F.greatest(F.lit(0), F.floor(n / 100) - 1)).alias("p1"), at(F.floor(n / 2)).alias("p50"), at(F.least(n - 1, F.floor(n * 99 / 100))).alias("p99"),
    )


def distinct_ratio(reads: DataFrame, start: int, end: int) -> DataFrame:
    """Per file: distinct windows by windows; null without any."""
    cut = reads.select("file", window(F.col("seq"), start, end).alias("w"))
    return cut.groupBy("file").agg(F.count("w").alias("n"), F.try_divide(F.count_distinct("w"), F.count("w")).alias("ratio"))


def modal_consensus(reads: DataFrame, start: int, end: int) -> DataFrame:
    """file, consensus: each column's most common called base; ties and empty columns go to the first of A, C, G, T."""
    cycles = per_cycle_composition(reads.select("file", window(F.col("seq"), start, end).alias("seq")))
    base = cycle_profile(cycles).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("cycle", "base"))).alias("x"))
    return base.select("file", F.array_join(F.transform("x", lambda s: s.base), "").alias("consensus"))


def consensus_match_rate(reads: DataFrame, start: int, end: int, mismatches: int) -> DataFrame:
    """Per file: share of windows within ``mismatches`` of the file's consensus; the others stay in the denominator."""
    cut = reads.select("file", window(F.col("seq"), start, end).alias("w")).where("w is not null")
    consensus = modal_consensus(reads, start, end)  # a row per file
    near = hamming(F.col("w"), F.col("consensus")) <= mismatches
    return cut.join(consensus, "file").groupBy("file", "consensus").agg(F.count("*").alias("n"), F.avg(near.cast("double")).alias("rate"))


def segments(cycles: DataFrame) -> DataFrame:
    """Runs of cycles per file: constant, homopolymer (four or more pure cycles of one base) or random.

    file, start, end (exclusive), kind, bases (of constant and homopolymer runs)."""
    total = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    most = F.greatest("n_a", "n_c", "n_g", "n_t")
    base = dominant({b: F.col(f"n_{b.lower()}") for b in BASES})
    rows = cycles.select("file", "cycle", F.when((total > 0) & (most >= total * PURE), base).otherwise(".").alias("base"))
    order = Window.partitionBy("file").orderBy("cycle")
    island = F.col("cycle") - F.row_number().over(Window.partitionBy("file", "base").orderBy("cycle"))
    rows = rows.withColumn("island", island)
    run = F.count("*").over(Window.partitionBy("file", "base", "island"))
    rows = rows.withColumn("kind", F.when(F.col("base") == ".", "random").when(run >= HOMOPOLYMER, F.concat(F.lit("homopolymer"), F.col("base"))).otherwise("constant"))
    step = F.when(F.col("kind") != F.lag("kind").over(order), 1).otherwise(0)
    rows = rows.withColumn("step", step).withColumn("part", F.sum("step").over(order))
    by = rows.groupBy("file", "part").agg(F.min("cycle").alias("start"), (F.max("cycle") + 1).alias("end"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("cycle", "base"))).alias("x"))
    bases = F.array_join(F.transform("x", lambda s: s.base), "")
    return by.select("file", "start", "end", F.regexp_extract("kind", "^(constant|homopolymer|random)", 1).alias("kind"), F.when(F.col("kind") != "random", bases).alias("bases"))


def motif_rate(reads: DataFrame, motif: str, start: int, mismatches: int = 1) -> DataFrame:
    """Per file: share of reads with the motif; reads uncalled at a constrained place leave the denominator."""
    off = motif_mismatches(F.col("seq"), motif, start)
    hit = F.when(off.isNotNull(), (off <= mismatches).cast("double"))
    return reads.groupBy("file").agg(F.count(hit).alias("n"), F.avg(hit).alias("rate"))


def motif_search(reads: DataFrame, motif: str, where: str = "anywhere", start: int = 0, end: int | None = None, most: int = 1) -> DataFrame:
    """Per file: n (reads that can tell) and rate (the share of them with the motif, see ``motif_found``); null without any."""
    hit = motif_found(F.col("seq"), motif, where, start, end, most).cast("double")
    return reads.groupBy("file").agg(F.count(hit).alias("n"), F.avg(hit).alias("rate"))


def onlist_hit_rate(reads: DataFrame, onlist: DataFrame, start: int, width: int, drift: int = 2, strands: tuple[str, ...] | list[str] = ("forward", "revcomp")) -> DataFrame:
    """Per file: the best share of windows in a list over strands and offsets.

    onlist: distinct barcodes (barcode). Windows with an uncalled base leave the denominator.
    The first best wins: forward before reverse complement, then the least offset. Every read
    is looked up at 2 * (2 * drift + 1) places, whatever the list's size."""
    places = [(strand * (2 * drift + 1) + offset + drift, strand, offset) for strand in range(2) if ("forward", "revcomp")[strand] in strands for offset in range(-drift, drift + 1)]
    cut = F.array(*(F.struct(F.lit(k).alias("place"), (w if not strand else reverse_complement(w)).alias("barcode")) for k, strand, offset in places if start + offset >= 0 for w in [window(F.col("seq"), start + offset, start + offset + width)]))
    tried = reads.select("file", F.explode(cut).alias("x")).select("file", "x.place", "x.barcode").where(F.col("barcode").rlike("^[ACGT]+$"))
    # the distinct windows of each place, before the join
    tried = tried.groupBy("file", "place", "barcode").count()
    hits = tried.join(onlist.select("barcode", F.lit(1).alias("known")).distinct(), "barcode", "left")
    by = hits.groupBy("file", "place").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.coalesce("known", F.lit(0))).alias("hits"))
    rate = F.col("hits") / F.col("n")
    best = by.groupBy("file").agg(F.max_by(F.struct("place", "n", "hits"), F.struct(rate, -F.col("place"))).alias("b"))
    offset = F.pmod(F.col("b.place"), F.lit(2 * drift + 1)) - drift
    return best.select("file", F.when(F.col("b.place") > 2 * drift, "revcomp").otherwise("forward").alias("strand"), offset.cast("int").alias("offset"), F.col("b.n").alias("n"), F.col("b.hits").alias("hits"))


def intersect_fraction(a: DataFrame, b: DataFrame, column: str = "barcode") -> DataFrame:
    """Shared values by the smaller set's size."""
    both = a.select(column, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(column, F.lit(0).alias("a"), F.lit(1).alias("b")))
    sides = both.groupBy(column).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = sides.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("shared"))
    return counts.select("n_a", "n_b", "shared", F.coalesce(F.try_divide("shared", F.least("n_a", "n_b")), F.lit(0.0)).alias("fraction"))


def extract_tags(reads: DataFrame, anchor: str, trailing: str, **geometry) -> DataFrame:
    """``reads`` (seq and any other columns) with tagged, start, umi, and seq cut to what lies behind the tag.

    Reads without a tag keep their bases, with null start and umi; a null read is untagged.
    For the geometry see ``tag_match``. No shuffle: one pass over the reads."""
    match = F.col("__tag")
    cut = F.when(match.isNull(), F.col("seq")).otherwise(F.substring(F.col("seq"), match["start"] + (geometry["cdna"] + 1), F.length("seq")))
    rows = reads.withColumn("__tag", tag_match(F.col("seq"), anchor, trailing, **geometry))
    return rows.withColumns({"seq": cut, "tagged": match.isNotNull(), "start": match["start"], "umi": match["umi"]}).drop("__tag")


def tag_profile(tagged: DataFrame, start: int) -> DataFrame:
    """Per file of ``extract_tags``: reads, tagged, drifted (tags not at ``start``), and the shares of tagged reads and drifted tags; a share of nothing is null."""
    by = tagged.groupBy("file").agg(F.count("*").alias("reads"), F.count_if("tagged").alias("tagged"), F.count_if(F.col("tagged") & (F.col("start") != start)).alias("drifted"))
    return by.select("*", F.try_divide("tagged", "reads").alias("tagged_share"), F.try_divide("drifted", "tagged").alias("drift_share"))
