"""Column functions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def called(seq: Column) -> Column:
    """Whether every base is A, C, G or T."""
    return seq.rlike("^[ACGT]*$")


def packed(seq: Column) -> Column:
    """The two-bit big-endian code as decimal(20, 0); null if a base is uncalled or the text empty. Up to 32 bases."""
    code = F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("decimal(20,0)")
    return F.when(called(seq) & (F.length(seq) > 0) & (F.length(seq) <= 32), code)


def unpacked(code: Column, width: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), width, "0"), "0123", "ACGT")


def window(seq: Column, start: int, end: int) -> Column:
    """Bases [start, end); null where the read does not reach the end: never a part."""
    return F.when(F.length(seq) >= end, F.substring(seq, start + 1, end - start))


def hamming(a: Column, b: Column) -> Column:
    """Differing places, and the difference in length."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    over = F.abs(F.length(a) - F.length(b))
    shared = F.slice(differ, 1, F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), over).otherwise(F.aggregate(shared, F.lit(0), lambda s, x: s + x) + over)


def entropy_bits(shares: list[Column]) -> Column:
    """Shannon bits of counts or shares, renormalised to their own sum; 0 without any."""
    total = sum(shares[1:], shares[0])
    bits = F.lit(0.0)
    for x in shares:
        bits = bits - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0)
    return F.when(total > 0, bits).otherwise(0.0)


def dominant(counts: dict[str, Column]) -> Column:
    """The key of the largest count; the first one wins ties."""
    most = F.greatest(*counts.values())
    out = None
    for key, count in counts.items():
        out = F.when(count == most, key) if out is None else out.when(count == most, key)
    return out


#: The letters of the IUPAC code and the bases each stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def motif_mismatches(seq: Column, motif: str, start: int) -> Column:
    """Mismatches of an IUPAC motif at an offset, over its constrained places; null if one of them is uncalled or missing."""
    out, clean = F.lit(0), F.length(seq) >= start + len(motif)
    for k, letter in enumerate(motif):
        if letter != "N":
            base = F.substring(seq, start + k + 1, 1)
            clean &= base.isin(*BASES)
            out = out + F.when(base.isin(*IUPAC[letter]), 0).otherwise(1)
    return F.when(clean, out)


def motif_found(seq: Column, motif: str, where: str = "anywhere", start: int = 0, end: int | None = None, most: int = 1) -> Column:
    """Whether a read has an IUPAC motif, with ``most`` substitutions or fewer, where it is looked for; null if the read can't tell.

    where: read_start, read_end, window (beginning at ``start`` to ``end``) or anywhere. A read shorter than the
    motif can't tell. An uncalled base at a constrained place loses the places it touches: all of them under
    read_start, read_end and a closed window, which are one claim; of an open search only those, and the read can't tell
    when none is left. A read that a declared window does not fit has not got the motif."""
    held = [(k, IUPAC[letter]) for k, letter in enumerate(motif) if letter != "N"]
    last = F.length(seq) - len(motif)
    closed = where in ("read_start", "read_end") or where == "window" and end is not None
    low = {"read_start": F.lit(0), "read_end": last, "window": F.lit(start)}.get(where, F.lit(0))
    high = {"read_start": F.lit(0), "read_end": last, "window": last if end is None else F.least(F.lit(end), last)}.get(where, last)
    base = lambda p, k: F.substring(seq, p + (k + 1), 1)

    def clean(p: Column) -> Column:
        out = F.lit(True)
        for k, _ in held:
            out &= base(p, k).isin(*BASES)
        return out

    def near(p: Column) -> Column:
        wrong = F.lit(0)
        for k, letters in held:
            wrong = wrong + F.when(base(p, k).isin(*letters), 0).otherwise(1)
        return wrong <= most

    places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    good = F.filter(places, clean)
    lost = (F.size(places) > 0) & ((F.size(good) == 0) | (F.lit(closed) & (F.size(good) < F.size(places))))
    return F.when((last >= 0) & F.lit(len(motif) > 0) & ~lost, F.exists(good, near))


def tag_match(seq: Column, anchor: str, trailing: str, *, start: int, umi: tuple[int, int], trail: int, cdna: int, drift: int = 24, most: int = 1) -> Column:
    """struct(start, umi) of the leftmost tag of a read; null without one, or without a read.

    The anchor may begin at ``start`` to ``start + drift``. From where it begins, ``umi`` gives
    the offset and length of the UMI, ``trail`` the offset of the trailing motif, which may have
    ``most`` substitutions, and ``cdna`` that of the first base behind the tag, which must be there."""

    def holds(at: Column) -> Column:
        wrong = F.lit(0)
        for k, base in enumerate(trailing):
            wrong = wrong + F.when(F.substring(seq, at + (trail + k + 1), 1) == base, 0).otherwise(1)
        ends = at + max(cdna, trail + len(trailing) - 1, umi[0] + umi[1] - 1)
        return (F.substring(seq, at + 1, len(anchor)) == anchor) & (F.length(seq) > ends) & (wrong <= most)

    first = F.get(F.filter(F.sequence(F.lit(start), F.lit(start + drift)), holds), F.lit(0))
    return F.when(seq.contains(anchor) & first.isNotNull(), F.struct(first.alias("start"), F.substring(seq, first + (umi[0] + 1), umi[1]).alias("umi")))


def quality_encoding(least: Column, most: Column) -> Column:
    return F.when(least.isNull() | most.isNull(), "unknown").when(least < 64, "phred33").when(most > 74, "phred64").otherwise("unknown")


#: How names that an archive has rewritten begin, and the index at the end of an instrument's name.
ARCHIVE_NAME = r"^[SED]RR\d+\.\d+"
NAME_INDEX = r"[ /]([ACGTN]{6,})(?:\+[ACGTN]{6,})?\s*$"


def read_name(name: Column) -> Column:
    """parsed, sra_normalized, instrument, run, flowcell, lane, tile and index of a colon-separated read name of seven fields or more.

    Else all but the flags are null. Lane and tile are numbers together or not at all."""
    name = F.regexp_replace(name, "^@", "")
    archive = F.coalesce(name.rlike(ARCHIVE_NAME), F.lit(False))
    head = F.split(name, ":")
    full = F.coalesce(~archive & (F.size(head) >= 7), F.lit(False))
    part = lambda k: F.when(full, F.get(head, F.lit(k)))
    lane, tile = (F.trim(part(k)).try_cast("int") for k in (3, 4))
    both = lane.isNotNull() & tile.isNotNull()
    index = F.when(full, F.nullif(F.regexp_extract(name, NAME_INDEX, 1), F.lit("")))
    return F.struct(full.alias("parsed"), archive.alias("sra_normalized"), part(0).alias("instrument"), part(1).alias("run"), part(2).alias("flowcell"), F.when(both, lane).alias("lane"), F.when(both, tile).alias("tile"), index.alias("index"))
