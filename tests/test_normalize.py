from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize as fn
from tessera.operators import spans


@pytest.mark.parametrize(
    "raw,want",
    [
        ("a\0b", "ab"), ("a\r\nb\rc\nd", "a b c d"), ("ﬁve ﬄ Œuvre", "five ffl OEuvre"), ("‘q’ “r” — 5′", "'q' \"r\" - 5'"), ("so­ft​ x y", "soft x y"),
        ("chemi-\nstry", "chemistry"), ("3-\nprime", "3-prime"), ("é-\nb", "é-b"), ("a-\nb-\nc", "abc"), ("a -\nb", "a - b"),
        ("one\ntwo\n\nthree\n \t\nfour", "one two\n\nthree\n\nfour"), ("a  \n\n  b", "a\n\nb"), ("x \t y", "x y"), ("  \n x \n ", "x"), ("", ""), (" \n", ""),
        ("é ½ Ｆｕｌｌ ｱﾞ", "é 1⁄2 Full ア゙"), ("\ud800x", "x"), ("a\n \n \nb", "a\n\nb"), ("…", "..."),
    ],
)
def test_worked_texts(raw, want):
    got, source = fn.canonical(raw)
    assert got == unicodedata.normalize("NFKC", want) if "ア" in want else got == want
    assert len(source) == len(got)
    assert all(0 <= s < len(raw) for s in source) and list(source) == sorted(source)


def plain(raw):
    """The steps over whole strings, without places."""
    text = re.sub("[\0\ud800-\udfff]", "", raw).replace("\r\n", "\n").replace("\r", "\n")
    for old, new in fn.PLAIN.items():
        text = text.replace(old, new)
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"(?<=[A-Za-z])-\n(?=[A-Za-z])", "", text)
    text = re.sub(r"(?<=\w)-\n(?=\w)", "-", text)
    paragraphs = [re.sub(r"[ \t]*\n[ \t]*", " ", p) for p in re.split(r"\n[ \t]*\n+", text)]
    text = re.sub(r"[ \t]{2,}", " ", "\n\n".join(paragraphs))
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def test_random_texts_and_their_maps():
    rng = random.Random(3)
    signs = ["a", "b", "Z", "3", "-", "-\n", "\n", "\n\n", " ", "\t", "\r\n", "\r", "é", "é", "́", "ﬁ", "’", "—", "­", " ", "½", "…", "한", "ᄒ", "ᅡ", "ᆫ", "क", "़", "ে", "া", "ｶ", "ﾞ", "x", "_"]
    for _ in range(3000):
        raw = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 25)))
        got, source = fn.canonical(raw)
        assert got == plain(raw), ascii(raw)
        at = dict(fn.breaks(source))
        last = None
        for k, place in enumerate(source.tolist()):
            last = at[k] - k if k in at else last
            assert k + last == place
        for k, c in enumerate(got):
            if c in "abZx3_":
                assert raw[source[k]] == c  # what is left as it was comes from itself


def test_spans_go_back_to_the_source(spark):
    raw = ["The chemi-\nstry of ﬁve\r\n\r\n“cells”", "", None, "plain"]
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw string").select("id", "raw", fn.mapped(F.col("raw")).alias("c"))
    rows = rows.withColumn("s", spans.find_span(F.col("c.text"), F.when(F.col("id") == 3, "plain").otherwise("chemistry  of five")))
    got = {r.id: r for r in rows.select("id", "c.text", "s", fn.source_span(F.col("c.map"), F.col("s.start"), F.col("s.end")).alias("o")).collect()}
    assert got[0].text == 'The chemistry of five\n\n"cells"' and got[0].s.how == "squashed"
    assert raw[0][got[0].o.start : got[0].o.end] == "chemi-\nstry of ﬁve"
    assert (got[1].text, got[1].s.how, got[1].o) == ("", None, None) and got[2].text is None and got[2].o is None
    assert tuple(got[3].o) == (0, 5)


def test_found_spans(spark):
    cases = [("a b  c", "b  c", 2, 6, "exact"), ("a b c", " b   c ", 2, 5, "squashed"), ("a b\n c", "b c", 2, 6, "flexible"), ("a", "", None, None, None), ("a", "  ", None, None, None), ("x (y) z", "(y)\nz", 2, 7, "squashed"), ("abc", "bd", None, None, None), (None, "a", None, None, None)]
    rows = spark.createDataFrame([(k, t, q) for k, (t, q, *_) in enumerate(cases)], "k int, t string, q string").select("k", spans.find_span(F.col("t"), F.col("q")).alias("s"))
    assert {r.k: tuple(r.s) for r in rows.collect()} == {k: tuple(c[2:]) for k, c in enumerate(cases)}


def test_pages_of_places(spark):
    pages = spark.createDataFrame([("d", 1, "abc"), ("d", 2, ""), ("d", 3, "xy")], "doc string, page int, text string")
    places = spark.createDataFrame([(k, "d", k) for k in range(-1, 11)] + [(99, "e", 0)], "span int, doc string, at int")
    got = {r.span: r.page for r in spans.page_of(places, spans.page_offsets(pages)).collect()}
    assert got == {-1: None, 0: 1, 1: 1, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: 3, 8: 3, 9: None, 10: None, 99: None}
