"""Canonical text, with the way back to its source.

Quotes are looked for in a canonical text, in which what prints alike reads alike. Every step of the rewrite is a list of
edits, so each canonical character knows the source character it came from; a text's map keeps only the places
where that distance changes. What Spark's own functions can't do to a text runs in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and the letters they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe"}
#: Marks that are printed for plainer ones; soft hyphens and spaces of no width go.
MARKS = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "′": "'", "″": '"', "­": "",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "​": "",
}
PLAIN = LIGATURES | MARKS

#: What a step finds, and what it puts there; the order of the steps matters.
STEPS: list[tuple[re.Pattern, object]] = [
    (re.compile("[\0\ud800-\udfff]"), ""),
    (re.compile("\r\n?"), "\n"),
    (re.compile("[" + "".join(PLAIN) + "]"), lambda m: PLAIN[m[0]]),
    (re.compile(r"[^\0-\x7f]+"), None),  # compatibility forms, cluster by cluster
    (re.compile(r"(?<=[A-Za-z])-\n(?=[A-Za-z])"), ""),  # a word broken over a line
    (re.compile(r"(?<=\w)-\n(?=\w)"), "-"),  # a hyphen that means something
    (re.compile(r"\n[ \t]*\n+"), "\0"),  # kept while lines are joined
    (re.compile(r"[ \t]*\n[ \t]*"), " "),
    (re.compile("\0"), "\n\n"),
    (re.compile(r"[ \t]{2,}"), " "),
]


def _clusters(run: str) -> list[str]:
    """A run of characters, the one before it included, in pieces that compose with no neighbour."""
    out: list[str] = []
    for c in run:
        joined = unicodedata.normalize("NFKC", (out[-1] if out else "") + c)
        if out and (unicodedata.combining(unicodedata.normalize("NFKD", c)[0]) or joined != unicodedata.normalize("NFKC", out[-1]) + unicodedata.normalize("NFKC", c)):
            out[-1] += c
        else:
            out.append(c)
    return out


def _compatible(text: str, found: re.Match) -> list[tuple[int, int, str]]:
    start = max(0, found.start() - 1)
    if unicodedata.is_normalized("NFKC", text[start : found.end()]):
        return []
    out, at = [], start
    for piece in _clusters(text[start : found.end()]):
        plain = unicodedata.normalize("NFKC", piece)
        if plain != piece:
            out.append((at, at + len(piece), plain))
        at += len(piece)
    return out


def _edited(text: str, source: np.ndarray, edits: list[tuple[int, int, str]]) -> tuple[str, np.ndarray]:
    """The text with edits (start, end, replacement) in order, and the source place of each character; a replacement comes from where it stands."""
    parts, places, at = [], [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        old = source[start:end]
        places += [source[at:start], old[: len(new)] if len(new) <= len(old) else np.concatenate([old, np.full(len(new) - len(old), old[-1])])]
        at = end
    return "".join([*parts, text[at:]]), np.concatenate([*places, source[at:]])


def canonical(text: str) -> tuple[str, np.ndarray]:
    """The canonical text and the source place of each of its characters."""
    source = np.arange(len(text))
    for pattern, new in STEPS:
        if new is None:
            edits = [e for m in pattern.finditer(text) for e in _compatible(text, m)]
        else:
            edits = [(m.start(), m.end(), new(m) if callable(new) else new) for m in pattern.finditer(text)]
        if edits:
            text, source = _edited(text, source, edits)
    # white space at the ends of lines, then at those of the text
    edits, at = [], 0
    for line in text.split("\n"):
        left, right = len(line) - len(line.lstrip()), len(line.rstrip())
        edits += [(at, at + left, ""), (at + max(left, right), at + len(line), "")]
        at += len(line) + 1
    text, source = _edited(text, source, [e for e in edits if e[0] < e[1]])
    left, right = len(text) - len(text.lstrip()), len(text.rstrip())
    return text[left : max(left, right)], source[left : max(left, right)]


def normalize(text: str) -> str:
    return canonical(text)[0]


def breaks(source: np.ndarray) -> list[tuple[int, int]]:
    """(place in the canonical text, place in the source) wherever their distance changes."""
    at = np.flatnonzero(np.diff(source, prepend=source[:1] - 2) != 1)
    return list(zip(at.tolist(), source[at].tolist(), strict=True))


def normalized(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize(t) for t in column.to_pylist()], pa.string())

    return run(text)


def mapped(text: Column) -> Column:
    """struct(text, map): the canonical text and its map, an array of struct(at, source) in order of ``at``."""

    @F.arrow_udf("struct<text:string,map:array<struct<at:int,source:int>>>")
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for t in column.to_pylist():
            found = None if t is None else canonical(t)
            rows.append(found and {"text": found[0], "map": [{"at": a, "source": s} for a, s in breaks(found[1])]})
        place = pa.struct([("at", pa.int32()), ("source", pa.int32())])
        return pa.array(rows, pa.struct([("text", pa.string()), ("map", pa.list_(place))]))

    return run(text)


def source_span(map_: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the source of the canonical characters [start, end): from the first to behind the last; null for none."""

    @F.arrow_udf("struct<start:int,end:int>")
    def run(maps: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        bounds = maps.offsets.to_numpy()
        at, source = (maps.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "source"))
        out = []
        for k, (a, b) in enumerate(zip(starts.to_pylist(), ends.to_pylist(), strict=True)):
            lo, hi = bounds[k], bounds[k + 1]
            if a is None or b is None or a >= b or lo == hi:
                out.append(None)
                continue
            first, last = (int(np.searchsorted(at[lo:hi], x, "right")) - 1 + lo for x in (a, b - 1))
            out.append({"start": int(source[first] + a - at[first]), "end": int(source[last] + b - at[last])})
        return pa.array(out, pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    return run(map_, start, end)


def clean_cell(value: Column) -> Column:
    """A table's cell as one run of words: white space inside it is one space, null the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(value.cast("string"), r"(?U)\s+", " ")), F.lit(""))


def casefolded(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else " ".join(re.sub(r"[-_/]", " ", t).casefold().split()) for t in column.to_pylist()], pa.string())

    return run(text)
