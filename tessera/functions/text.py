"""Column functions over free text, names and loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophes; a hyphen parts."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), F.lit("[a-z0-9']+"), 0)


def token_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def token_skeleton(text: Column) -> Column:
    """What stands between tokens: texts that differ in tokens alone share it."""
    return F.array_join(F.split(text, TOKEN), "\x01")


def carries(text: Column, form: Column, stop: list[str]) -> Column:
    """Whether a text holds a form: as a substring, or all of the form's tokens but stop words."""
    wanted = F.array_except(tokens(form), F.array(*map(F.lit, stop)))
    inside = F.contains(F.lower(squash(text)), F.lower(squash(form)))
    return inside | (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(text))) == 0)


def key_form(text: Column) -> Column:
    """An attribute name's form as a key."""
    return F.translate(F.lower(F.trim(text)), " -", "__")


def as_number(text: Column) -> Column:
    """A number, or n% as n / 100; anything else null."""
    percent = F.rtrim(F.trim(text)).endswith("%")
    return F.when(percent, F.regexp_replace(F.trim(text), "%$", "").try_cast("double") / 100).otherwise(F.trim(text).try_cast("double"))


_DIGITS = r"\d+(?:_\d+)*"


def value_kind(text: Column) -> Column:
    """int, float or str: what a value is read as. Digits may be grouped by underscores; inf and nan are floats."""
    value = F.trim(text)
    return F.when(value.rlike(rf"^[+-]?{_DIGITS}$"), "int").when(value.rlike(rf"^[+-]?(({_DIGITS}\.({_DIGITS})?|\.{_DIGITS}|{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"), "float").otherwise("str")


def grade(value: Column, warn: Column, bad: Column, higher_is_better: bool = True) -> Column:
    """ok, warn or bad by two inclusive bars; none if the value or a bar is missing."""
    if higher_is_better:
        level = F.when(value >= warn, "ok").when(value >= bad, "warn").otherwise("bad")
    else:
        level = F.when(value <= warn, "ok").when(value <= bad, "warn").otherwise("bad")
    return F.when(value.isNull() | warn.isNull() | bad.isNull(), "none").otherwise(level)


def _tenths(n: Column, unit: int) -> Column:
    """n / unit to one place, rounded as printf does: a tie goes where the double n / unit lies, and to the even tenth if that is the tie itself."""
    rest = n % unit * 10
    t = F.round((n - n % unit) / unit).cast("long") * 10 + ((rest - rest % unit) / unit).cast("long")
    over = rest % unit * 2
    # both differences are exact: the sign of 20 * double - (2 * t + 1)
    tie = (n / unit * 16 - (t * 2 + 1)) + n / unit * 4
    up = (over > unit) | (over == unit) & ((tie > 0) | (tie == 0) & (t % 2 == 1))
    t = t + up.cast("long")
    return F.concat(((t - t % 10) / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def one_decimal(x: Column) -> Column:
    """A double to one place, rounded as printf does: by its binary value, an exact tie to the even tenth."""
    size = F.abs(x)
    t = F.floor(size * 10)
    # both differences are exact: the sign of 20 * size - (2 * t + 1)
    tie = (size * 16 - (t * 2 + 1)) + size * 4
    t = t + ((tie > 0) | (tie == 0) & (t % 2 == 1)).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), ((t - t % 10) / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def short_count(n: Column) -> Column:
    """1.2K, 3.4M or 5.6B; a sign stays."""
    sign, size = F.when(n < 0, "-").otherwise(""), F.abs(n)
    short = (
        F.when(size >= 1_000_000_000, F.concat(_tenths(size, 1_000_000_000), F.lit("B")))
        .when(size >= 1_000_000, F.concat(_tenths(size, 1_000_000), F.lit("M")))
        .when(size >= 1000, F.concat(_tenths(size, 1000), F.lit("K")))
        .otherwise(size.cast("string"))
    )
    return F.concat(sign, short)


#: Accession patterns of public archives and the kind each names, in the order they are tried.
ACCESSIONS = [(r"^[SED]RP\d+$", "study"), (r"^[SED]RX\d+$", "experiment"), (r"^[SED]RS\d+$", "sample"), (r"^[SED]RR\d+$", "run"), (r"^PRJ[EDN][A-Z]\d+$", "project"), (r"^SAM[EDN][A-Z]?\d+$", "biosample"), (r"^GSE\d+$", "series"), (r"^GSM\d+$", "series sample")]


def accession_kind(accession: Column) -> Column:
    out = None
    for pattern, kind in ACCESSIONS:
        hit = accession.rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def lane_of(name: Column) -> Column:
    return F.regexp_extract(name, r"_(L\d{3})(?:_|\.)", 1)


def read_designation(name: Column) -> Column:
    """R1 to R4 or I1 to I4 (in any case) at the end of a file name, a set number apart; else a last 1 to 4, alone or after ``read``; else null."""
    stem = F.regexp_replace(name, r"(?i)\.(fastq|fq)(\.gz)?$", "")
    lettered = F.upper(F.regexp_extract(stem, r"(?i)[._]([RI][1-4])(?:[._]\d{3})?$", 1))
    bare = F.regexp_extract(stem, r"(?i)[._](?:read[-_]?)?([1-4])(?:[._]\d{3})?$", 1)
    return F.when(lettered != "", lettered).when(bare != "", bare)


def run_key(name: Column) -> Column:
    """The run that a file belongs to: an archive run's accession, else the name without mate, lane and extension."""
    accession = F.regexp_extract(name, r"^([SED]RR\d+)", 1)
    stem = F.regexp_replace(name, r"\.(fastq|fq)(\.gz)?$", "")
    stem = F.regexp_replace(stem, r"_(?:[RI][12]|[1-4])(_001)?$", "")
    return F.when(accession != "", accession).otherwise(F.regexp_replace(stem, r"_L\d{3}$", ""))


def hashed_key(tag: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(tag), *parts), 256)
