"""License scans by sentence rules.

A text is cut into sentences: lines that are only wrapped are joined again, comment signs before
them gone; a sentence ends at a mark before white space and what is no lower-case letter, or at
a blank line. Each sentence is normalised (lower case; letters, digits and dots between digits
stay, anything else is one space) and mapped to the identifier of the known licence sentence
that it holds, by patterns tried in order. The identifiers of a text, in order, are then matched
against ordered licence rules, longest first: a rule is a run of identifiers with nothing known
in between; what a rule matches is used up. Everything is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between sentences.
CUT = "\x1e"
#: Replacements that cut a text into sentences, in order: pattern, what comes instead.
STEPS: list[tuple[str, str]] = [
    (r"\r\n?", "\n"),
    (r"(^|\n)[ \t\f]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--|>+)?[ \t\f]*", r"\1"),
    (r"([Ss][Pp][Dd][Xx]-[Ll][Ii][Cc][Ee][Nn][Ss][Ee]-[Ii][Dd][Ee][Nn][Tt][Ii][Ff][Ii][Ee][Rr]:[^\n]*)", "\n\n" + r"\1" + "\n\n"),
    (r"\n\n+", CUT),
    (r"\n", " "),
    (r"(^|[^A-Za-z0-9])[Vv](?:ersion|er)?\.? ?([0-9])", r"\1version \2"),
    (r"([.!?])[ \x1e]+([^a-z \x1e])", rf"\1{CUT}\2"),
]
#: Sentences without any of these are not looked up.
TELLING = r"licen[sc]e|copyright|permission|redistribut|warrant|spdx|reserved|neither the name|in no event|advertising material|public domain|copy of the mpl|under (the )?(cc|mit|isc|bsd|[al]?gpl|mpl)"
#: Normalising replacements after lower-casing.
NORMAL: list[tuple[str, str]] = [(r"[^a-z0-9.]+", " "), (r"\.+( |$)", " "), (r"(^|[^0-9])\.+", r"\1"), (r"licence", "license"), (r" +", " "), (r"^ | $", "")]
#: What says that a licence is not given.
NEGATED = r"(^| )(not|never|no longer|isn t|aren t|wasn t|cannot be|unlike|instead of|rather than)( [a-z0-9.]+){0,3} ((licensed|released|distributed|available|published|provided) )?under( |$)"

UNDER = r"(licensed|released|distributed|available|published|shared|provided|redistributed|covered) under( the terms of| the terms and conditions of| a| an)?( the)?( terms of the)? "


def _public_licenses() -> list[tuple[str, str, str]]:
    """Identifier, pattern and licence of the notices and mentions of the GNU licences, versions told apart."""
    out = []
    for name, kind, versions in (("AGPL", "affero ", ("3",)), ("LGPL", "(lesser |library )", ("2.1", "2", "3")), ("GPL", "", ("3", "2", "1"))):
        own = f"gnu {kind}general public license"
        for v in versions:
            number, spdx = v.replace(".", r"\.") + r"(\.0)?", f"{name}-{v}" + ("" if "." in v else ".0")
            foundation = f"{own}( version {number})? as published by the free software foundation"
            out.append((f"{spdx}-or-later", rf"under the terms of (the )?{foundation}( either)? version {number}( of the license)? or at your option any later version", f"{spdx}-or-later"))
            out.append((f"{spdx}-only", rf"under the terms of (the )?(version {number} of the {own} as published|{own} version {number} as published|{foundation} version {number}( of the license)?($| only))", f"{spdx}-only"))
            out.append((spdx, rf"{UNDER}({own}( version)? {number}|(gnu )?{name.lower()} ?(version |v)?{number})( |$)", spdx))
        out.append((name, rf"{UNDER}({own}|(gnu )?{name.lower()})( |$)", name))
    return out


def _creative_commons() -> list[tuple[str, str, str]]:
    out = []
    for name, words, short in (("NC-SA", "non ?commercial share ?alike", "nc sa"), ("NC-ND", "non ?commercial no ?deriv(ative)?s?", "nc nd"), ("NC", "non ?commercial", "nc"), ("SA", "share ?alike", "sa"), ("ND", "no ?deriv(ative)?s?", "nd"), ("", "", "")):
        mention = rf"{UNDER}(creative commons attribution{words and ' ' + words}|cc by{short and ' ' + short})"
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0", ""):
            spdx = "-".join(x for x in ("CC-BY", name, v) if x)
            out.append((spdx, mention + (rf"( international| unported| generic)?( public)?( license)?( version)? {v}( |$)".replace(".", r"\.") if v else "( |$)"), spdx))
    return out


#: Names by which a sentence may call a licence, and the licence; the first that fits at a place counts.
NAMES: list[tuple[str, str]] = [
    (r"(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "BSD-3-Clause"), (r"(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "BSD-2-Clause"), (r"bsd", "BSD"),
    (r"apache( software)?( license)?( version)?( ?2(\.0)?)?", "Apache-2.0"), (r"(mit x11|mit expat|mit)", "MIT"), (r"isc", "ISC"),
    *((rf"{name.lower()} ?(version |v)?{v.replace('.', '[.]')}(\.0)?{how}", f"{name}-{v}" + ("" if "." in v else ".0") + tail) for name, vs in (("AGPL", ("3",)), ("LGPL", ("2.1", "3", "2")), ("GPL", ("3", "2"))) for v in vs for how, tail in ((" only", "-only"), (" or later", "-or-later"), ("", ""))),
    (r"(mozilla public license|mpl)( version)? ?2(\.0)?", "MPL-2.0"), (r"(cc0|unlicense)", "CC0-1.0"), (r"artistic( license)?( version)? 2(\.0)?", "Artistic-2.0"),
]
_NAME = "(" + "|".join(p for p, _ in NAMES) + ")( licenses?)?"
_CALLED = r"( the| a| an| either| either of| either of the)*"
#: Sentences that name licences, one or several, and no more: the names are looked for in them.
NAMED = [
    rf"(under|license[ds]?|licensed?)( the terms of)?{_CALLED} {_NAME} (and|or|and or){_CALLED} {_NAME}( |$)",
    rf"^(the )?licenses? (is |are )?{_NAME}$",
    rf"{UNDER}{_NAME}( |$)",
]

#: Identifiers of known licence sentences and what their normalised forms hold; the first that fits counts.
SENTENCES: list[tuple[str, str]] = [
    ("spdx", r"^spdx license identifier .+"),
    ("named", NAMED[0]),
    ("mit-title", r"^(the )?mit license( mit)?$"),
    ("gpl-3-title", r"^gnu general public license version 3 29 june 2007"),
    ("gpl-2-title", r"^gnu general public license version 2 june 1991"),
    ("agpl-3-title", r"^gnu affero general public license version 3 19 november 2007"),
    ("lgpl-3-title", r"^gnu lesser general public license version 3 29 june 2007"),
    ("cc-by-4-title", r"^(creative commons )?attribution 4\.0 international( public license)?$"),
    ("artistic-title", r"^the artistic license 2\.0"),
    ("apache-grant", UNDER + r"apache (software )?license( version)? 2(\.0)?( |$)"),
    ("apache-title", r"^apache license version 2\.0 january 2004"),
    ("apache-use", r"you may not use (this file|these files|this software) except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)? to deal in the software without restriction"),
    ("mit-notice", r"the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit-liability", r"in no event shall the .*(authors|copyright holders?).* be liable for any claim damages or other liability"),
    ("mit-mention", UNDER + r"mit( x11)? license"),
    ("isc-grant", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted$"),
    ("isc-as-is", r"the software is provided as is and .+ disclaims all warranties with regard to this software"),
    ("isc-mention", UNDER + r"isc license"),
    ("bsd-head", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-advert", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-names", r"(neither the names? of .+|the names? of .+ may not be used|may not) ?(may be used)? ?to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", r"this software is provided by .+ as is and any express or implied warranties"),
    ("bsd-liability", r"in no event shall .+ be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-mention", UNDER + r"(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( |$)"),
    ("bsd-2-mention", UNDER + r"(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( |$)"),
    ("mpl-1.1", r"subject to the mozilla public license version 1\.1"),
    ("mpl-2", r"(subject to the terms of the|" + UNDER + r")( ?)mozilla public license( version)? 2(\.0)?( |$)"),
    ("mpl", r"(subject to the terms of the|" + UNDER + r")( ?)(mozilla public license|mpl)"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file"),
    *((i, p) for i, p, _ in _public_licenses()),
    ("gpl-hope", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", r"you should have received a copy of the gnu (affero |lesser |library )?general public license"),
    *((i, p) for i, p, _ in _creative_commons()),
    ("cc0", UNDER + r"(creative commons zero|creative commons cc0|cc0)"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("boost", UNDER + r"boost software license( version)? 1\.0"),
    ("zlib-as-is", r"this software is provided as is without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("epl-2", UNDER + r"eclipse public license( version)? 2(\.0)?"),
    ("named", "|".join(f"({p})" for p in NAMED[1:])),
    ("reserved", r"all rights reserved$"),
    ("copyright", r"copyright (c )?[0-9]{4}"),
]
#: Ordered rules over those identifiers, and the licence each gives; single notices and mentions follow.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("bsd-head", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"), "BSD-4-Clause"),
    (("bsd-head", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability"), "BSD-3-Clause"),
    (("bsd-head", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-head", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"), "BSD-2-Clause"),
    (("bsd-head", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("apache-grant", "apache-copy", "apache-as-is", "apache-see"), "Apache-2.0"),
    (("mit-grant", "mit-notice", "mit-as-is", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("0bsd-grant", "isc-as-is"), "0BSD"),
    (("zlib-as-is", "zlib-grant"), "Zlib"),
    (("apache-grant",), "Apache-2.0"),
    (("apache-title",), "Apache-2.0"),
    (("mit-title",), "MIT"),
    (("gpl-3-title",), "GPL-3.0"),
    (("gpl-2-title",), "GPL-2.0"),
    (("agpl-3-title",), "AGPL-3.0"),
    (("lgpl-3-title",), "LGPL-3.0"),
    (("cc-by-4-title",), "CC-BY-4.0"),
    (("artistic-title",), "Artistic-2.0"),
    (("mit-mention",), "MIT"),
    (("isc-grant",), "ISC"),
    (("isc-mention",), "ISC"),
    (("bsd-3-mention",), "BSD-3-Clause"),
    (("bsd-2-mention",), "BSD-2-Clause"),
    (("mpl-1.1",), "MPL-1.1"),
    (("mpl-2",), "MPL-2.0"),
    (("mpl",), "MPL"),
    (("cc0",), "CC0-1.0"),
    (("unlicense",), "Unlicense"),
    (("boost",), "BSL-1.0"),
    (("epl-2",), "EPL-2.0"),
    *(((i,), licence) for i, _, licence in [*_public_licenses(), *_creative_commons()]),
]
#: The licence of a text that reserves all rights and states no licence.
RESERVED = "Proprietary"


def normalised(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, put in NORMAL:
        out = F.regexp_replace(out, pattern, put.replace("\\", "$"))
    return out


def sentence_id(normal: Column) -> Column:
    """The identifier of a normalised sentence, or null."""
    out = F.when(normal.rlike(NEGATED), F.lit(None).cast("string"))
    for name, pattern in SENTENCES:
        out = out.when(normal.rlike(pattern), F.lit(name))
    return out


def names_in(normal: Column) -> Column:
    """The licences that a sentence names; a name that is part of one found before is not looked at again."""
    rest, found = normal, []
    for pattern, licence in NAMES:
        whole = rf"(^| )({pattern})( |$)"
        found.append(F.when(rest.rlike(whole), F.lit(licence)))
        rest = F.regexp_replace(rest, whole, " - ")
    return F.array_compact(F.array(*found))


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences that the texts of ``docs`` (doc_id, text; other columns are left out) state.

    Per row: doc_id, n_sentences, n_known (known licence sentences), sentence_ids (their
    identifiers, in order, joined by commas), licenses (distinct SPDX names, sorted, joined by
    commas; an SPDX line adds its own as SPDX:..., a sentence that names several all of them; Proprietary if all rights are reserved and
    nothing else is stated) and licensed. Sentences that say that something is not under a
    licence count as unknown. A null or empty text has no sentences; repeated rows repeat; an
    empty table gives an empty result."""
    text = F.coalesce("text", F.lit(""))
    for pattern, put in STEPS:
        text = F.regexp_replace(text, pattern, put.replace("\\", "$"))
    sentences = F.filter(F.split(text, CUT), lambda s: F.trim(s) != "")
    rows = docs.select("doc_id", sentences.alias("s"))
    # normalised once, then looked up
    telling = F.transform(F.filter("s", lambda s: F.lower(s).rlike(TELLING)), lambda s: F.struct(normalised(s).alias("n"), s.alias("s")))
    telling = F.transform(telling, lambda x: F.struct(sentence_id(x.n).alias("id"), x.s.alias("s"), x.n.alias("n")))
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.filter(telling, lambda x: x.id.isNotNull()).alias("known"))
    spdx = F.transform(F.filter("known", lambda x: x.id == "spdx"), lambda x: F.concat(F.lit("SPDX:"), F.regexp_extract(x.s, r":[ \t]*(.*?)[ \t*/>-]*$", 1)))
    called = F.flatten(F.transform(F.filter("known", lambda x: x.id == "named"), lambda x: names_in(x.n)))
    rows = rows.select("doc_id", "n_sentences", F.transform("known", lambda x: x.id).alias("ids"), F.concat(spdx, called).alias("spdx"))
    rules = F.array(*(F.struct(F.lit("|" + "|".join(run) + "|").alias("run"), F.lit(licence).alias("licence")) for run, licence in RULES))
    start = F.struct(F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")).alias("rest"), F.array().cast("array<string>").alias("hits"))
    # each rule works on what earlier rules left
    hits = F.aggregate(
        rules,
        start,
        lambda at, rule: F.struct(F.replace(at.rest, rule.run, F.lit("|-|")).alias("rest"), F.when(F.contains(at.rest, rule.run), F.array_append(at.hits, rule.licence)).otherwise(at.hits).alias("hits")),
        lambda at: at.hits,
    )
    hits = F.when(F.size("ids") > 0, hits).otherwise(F.array().cast("array<string>"))
    named = F.array_sort(F.array_distinct(F.concat(hits, "spdx")))
    rows = rows.select("doc_id", "n_sentences", "ids", named.alias("named"))
    named = F.when((F.size("named") == 0) & F.array_contains("ids", "reserved"), F.array(F.lit(RESERVED))).otherwise(F.col("named"))
    return rows.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(named, ",").alias("licenses"), (F.size(named) > 0).alias("licensed"))


def _quoted(text: str) -> str:
    """A SQL string; control characters by their codes."""
    parts, out = text.replace("'", "''"), ""
    for c in parts:
        out += c if c >= " " else f"' || chr({ord(c)}) || '"
    return f"'{out}'"


def _sql() -> str:
    text = "coalesce(text, '')"
    for pattern, put in STEPS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    normal = "lower(s)"
    for pattern, put in NORMAL:
        normal = f"regexp_replace({normal}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    lists, rest = [], "n"
    for pattern, licence in NAMES:
        whole = rf"(^| )({pattern})( |$)"
        lists.append(f"CASE WHEN regexp_matches({rest}, {_quoted(whole)}) THEN '{licence}' END")
        rest = f"regexp_replace({rest}, {_quoted(whole)}, ' - ', 'g')"
    called = f"list_filter([{', '.join(lists)}], lambda x: x IS NOT NULL)"
    case = " ".join(f"WHEN regexp_matches(n, {_quoted(p)}) THEN '{k}'" for k, p in SENTENCES)
    steps, hits = "", []
    for k, (run, licence) in enumerate(RULES):
        found = "'|" + "|".join(run) + "|'"
        hits.append(f"CASE WHEN contains(r{k}, {found}) THEN '{licence}' END")
        steps += f",\nq{k + 1} AS (SELECT *, replace(r{k}, {found}, '|-|') AS r{k + 1} FROM q{k})"
    return f"""
WITH t AS (SELECT doc_id, list_filter(string_split({text}, chr({ord(CUT)})), lambda x: trim(x) <> '') AS s FROM documents),
e AS (
  SELECT doc_id, i, s[i] AS s FROM t, unnest(range(1, len(s) + 1)) AS u(i)
  WHERE regexp_matches(lower(s[i]), {_quoted(TELLING)})),
n AS (SELECT doc_id, i, s, {normal} AS n FROM e),
k AS (SELECT doc_id, i, s, n, CASE WHEN regexp_matches(n, {_quoted(NEGATED)}) THEN NULL {case} END AS id FROM n),
g AS (
  SELECT doc_id, count(*) AS n_known, string_agg(id, '|' ORDER BY i) AS ids,
    list_concat(coalesce(list('SPDX:' || regexp_extract(s, ':[ \\t]*(.*?)[ \\t*/>-]*$', 1)) FILTER (id = 'spdx'), []), coalesce(flatten(list({called}) FILTER (id = 'named')), [])) AS spdx
  FROM k WHERE id IS NOT NULL GROUP BY doc_id),
q0 AS (
  SELECT t.doc_id, len(t.s) AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(ids, '') AS ids, spdx, '|' || coalesce(ids, '') || '|' AS r0
  FROM t LEFT JOIN g USING (doc_id)){steps},
f AS (
  SELECT *, list_sort(list_distinct(list_concat(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL), coalesce(spdx, [])))) AS named FROM q{len(RULES)}),
p AS (SELECT *, CASE WHEN len(named) = 0 AND contains(r0, '|reserved|') THEN ['{RESERVED}'] ELSE named END AS stated FROM f)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_known AS BIGINT) AS n_known, replace(ids, '|', ',') AS sentence_ids,
  coalesce(array_to_string(stated, ','), '') AS licenses, len(stated) > 0 AS licensed
FROM p
"""


ORACLE_SQL = _sql()
