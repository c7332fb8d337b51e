"""Frames: where the elements of a layout lie in each single read.

Some layouts begin with elements of no fixed length, so that all behind them stand elsewhere in every
read. A phase is one choice of those lengths; it puts each element at fixed places. A read's frame is the
phase whose linkers (elements of a known sequence) all match, with fewest mismatches; a
read without one has no frame and takes no part. The phases are known before any read is: the search
is a few column expressions, and a linker is compared once however many phases share its place."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequence import called, reverse_complement

#: Fixed value: substitutions that a linker may have if its element states no other.
LINKER_MISMATCHES = 1
#: The strands that a barcode is looked up on, in the order of preference.
STRANDS = {"forward": ["forward"], "revcomp": ["revcomp"], "either": ["forward", "revcomp"]}


@dataclass(frozen=True)
class Element:
    """A part of a read.

    Its width is end - start, else the length of its sequence, else ``least`` if that equals ``most``; one with
    least < most is as long as the phase says; ``bio`` elements without an end, and others of no known width, run to the end of
    the read and must come last. It begins at ``offset`` from the end (``side``: or start) of the element ``after`` or, if that is
    "read", from the read's start; without ``after`` at ``start`` or where the one before it ends."""

    name: str
    sequence: str | None = None
    start: int | None = None
    end: int | None = None
    least: int | None = None
    most: int | None = None
    after: str | None = None
    side: str = "end"
    offset: int = 0
    mismatches: int | None = None
    bio: bool = False

    @property
    def floats(self) -> bool:
        return self.after is not None

    @property
    def varies(self) -> bool:
        return not (self.bio and self.end is None) and self.least is not None and self.most is not None and self.least < self.most

    def width(self) -> int | None:
        if self.start is not None and self.end is not None:
            return self.end - self.start
        if self.sequence is not None:
            return len(self.sequence)
        return self.least if self.least is not None and self.least == self.most else None


Layout = list[Element]
Phase = dict[str, tuple[int, int | None]]  # no end: that of the read


def phases(layout: Layout) -> list[Phase]:
    """The windows of every choice of lengths that can fit a read at all, in the order of lengths; none without a linker."""
    if not any(e.sequence is not None for e in layout):
        return []
    loose = [e for e in layout if e.varies]
    placed = [_placed(layout, dict(zip((e.name for e in loose), sizes, strict=True))) for sizes in product(*(range(e.least, e.most + 1) for e in loose))]
    return [p for p in placed if p]


def _placed(layout: Layout, sizes: dict[str, int]) -> Phase | None:
    windows: Phase = {}
    at = 0
    for k, e in enumerate(layout):
        ref = windows.get(e.after) if e.after else None
        if ref:
            start = (ref[0] if e.side == "start" else ref[1]) + e.offset
        elif e.after == "read":
            start = e.offset
        elif e.after:
            start = at + e.offset
        else:
            start = at if e.start is None else e.start
        width = sizes.get(e.name, e.width())
        if start < 0 or width is None and k + 1 < len(layout):
            return None
        at = None if width is None else start + width
        windows[e.name] = (start, at)
    return windows


def phased(reads: DataFrame, layout: Layout) -> DataFrame:
    """``reads`` (seq and any other columns) with phase, the number of a read's best phase (the first of several), and mismatches; null without a frame."""
    compared: dict[tuple[int, int, str], str] = {}
    frames = []
    for k, windows in enumerate(phases(layout)):
        places = []
        for e in layout:
            if e.sequence is not None:
                key = (*windows[e.name], e.sequence)
                places.append((compared.setdefault(key, f"__linker{len(compared)}"), LINKER_MISMATCHES if e.mismatches is None else e.mismatches))
        fits = F.length("seq") >= max(end if end is not None else 0 for _, end in windows.values())
        for name, most in places:
            fits &= F.col(name) <= most
        frames.append(F.when(fits, sum((F.col(name) for name, _ in places[1:]), F.col(places[0][0])) * F.lit(1 << 20) + F.lit(k)))
    # what each place is off by is a column of its own, so that no phase compares it anew
    rows = reads.select("*", *(_off(*key).alias(name) for key, name in compared.items()))
    best = F.least(*frames) if len(frames) > 1 else frames[0] if frames else F.lit(None).cast("int")
    rows = rows.withColumn("__best", best)
    return rows.select(*(F.col(f"`{c}`") for c in reads.columns), F.pmod("__best", F.lit(1 << 20)).cast("int").alias("phase"), F.shiftright("__best", 20).cast("int").alias("mismatches"))


def _off(start: int, end: int, linker: str) -> Column:
    """Substitutions of a linker at a fixed place, and the difference in length."""
    off = F.lit(abs(end - start - len(linker)))
    for at, letter in zip(range(start, end), linker, strict=False):
        off = off + (F.substring("seq", at + 1, 1) != letter).cast("int")
    return off


def bases(layout: Layout, name: str) -> Column:
    """The bases of an element of phased reads; null without a frame or for an element of no width."""
    windows = [w[name] for w in phases(layout)]
    if not windows:
        return F.lit(None).cast("string")
    start = F.get(F.array(*(F.lit(a) for a, _ in windows)), F.col("phase"))
    if windows[0][1] is None:
        return F.nullif(F.substring(F.col("seq"), start + 1, F.length("seq")), F.lit(""))
    width = F.get(F.array(*(F.lit(b - a if b > a else None).cast("int") for a, b in windows)), F.col("phase"))
    return F.substring(F.col("seq"), start + 1, width)


def framed(reads: DataFrame, layout: Layout) -> DataFrame:
    """``phased`` reads with windows: a map from element to struct(start, end), null without a frame."""
    table = F.array(*(F.create_map(*(x for name, (a, b) in windows.items() for x in (F.lit(name), F.struct(F.lit(a).alias("start"), (F.length("seq") if b is None else F.lit(b)).alias("end"))))) for windows in phases(layout)))
    empty = F.lit(None).cast("map<string, struct<start:int,end:int>>")
    return phased(reads, layout).withColumn("windows", F.get(table, F.col("phase")) if phases(layout) else empty)


def element_bases(reads: DataFrame, layout: Layout, name: str) -> DataFrame:
    """file, bases of one element in each read (file, seq) whose frame is found and in which it has any."""
    return phased(reads.select("file", "seq"), layout).select("file", bases(layout, name).alias("bases")).where("bases is not null")


def anchored_distinct_ratio(reads: DataFrame, layout: Layout, name: str) -> DataFrame:
    """Per file: n (reads with the element) and ratio (distinct bases of it by n); null if no frame was found. A file keeps its row."""
    rows = phased(reads.select("file", "seq"), layout).select("file", bases(layout, name).alias("bases"))
    return rows.groupBy("file").agg(F.count("bases").alias("n"), F.try_divide(F.count_distinct("bases"), F.count("bases")).alias("ratio"))


def anchored_hit_rate(reads: DataFrame, layout: Layout, name: str, onlist: DataFrame, width: int, orientation: str = "either") -> DataFrame:
    """Per file: the better strand's share of an element's bases in a list (barcode): strand, n, hits.

    Only bases of the list's width and without an uncalled base count: the others say nothing about the list. The
    frame is the offset, so none is searched. Without a hit on any strand: forward, n and hits 0. A file keeps its row."""
    cut = phased(reads.select("file", "seq"), layout).select("file", bases(layout, name).alias("bases"))
    found = cut.groupBy("file", "bases").count()  # distinct windows before the join
    clear = F.when((F.length("bases") == width) & called(F.col("bases")), F.col("bases"))
    tries = F.array(*(F.struct(F.lit(k).alias("place"), (clear if s == "forward" else reverse_complement(clear)).alias("barcode")) for k, s in enumerate(STRANDS[orientation])))
    tried = found.select("file", "count", F.explode(tries).alias("x")).select("file", "count", "x.*")
    known = onlist.select("barcode", F.lit(1).alias("known")).distinct()
    n = F.sum(F.when(F.col("barcode").isNotNull(), F.col("count")))
    by = tried.join(known, "barcode", "left").groupBy("file", "place").agg(n.alias("n"), F.sum(F.when(F.col("known") == 1, F.col("count")).otherwise(0)).alias("hits"))
    best = by.where("hits > 0").groupBy("file").agg(F.max_by(F.struct("place", "n", "hits"), F.struct(F.col("hits") / F.col("n"), -F.col("place"))).alias("b"))
    names = F.array(*(F.lit(s) for s in STRANDS[orientation]))
    rows = reads.select("file").distinct().join(best, "file", "left")
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0)).cast("long").alias(c)
    return rows.select("file", F.coalesce(F.get(names, F.col("b.place")), F.lit("forward")).alias("strand"), zero("n"), zero("hits"))
