"""HTML extraction: templates deduced from equivalence classes of tokens over same-host pages.

A token is an open tag with its path of tags, ids and classes, or a whole text block with its
path. Tokens of one host and page type that have the same occurrence vector (how often on each page) form an
equivalence class. A token stays in its class if it has the same place in the class's order on
all its pages, and its class nests if each token that stays always follows the same token of
the frame, the classes on most of the pages. Valid nested classes are the template. Pages are of
one type if they have the same elements below the body, so a section with a layout of its own has its own template.

The template's tags divide a page into slots: a text belongs to the innermost template tag around it. How much
text each slot holds over all pages of the type, links against it and the template's own texts left out, tells
where the article is: from the root on, the way leads into that slot, of those that come once on a page, which
holds more than half of what there is, as long as there is one. Tags and words of classes decide nothing but ties:
where no slot holds half, and for headings and named parts beside the chosen slot. All texts of the chosen slot
stay, passages that many pages share included, but elements that are never main text by their tag. Where the way
ends at the root or body, the texts of all slots stay but link lists and the template's own.

Every page is parsed once. Occurrence vectors are compared by a sum of hashes over page
shapes, so no task ever holds the pages of a host, and classes are checked shape by shape."""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, arrow_limits, stored

#: The elements of HTML that stand for themselves, hold raw text, or break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open one of the second kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK if t not in CLOSES and t not in ("body", "head", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption")}
SCOPE = frozenset("article aside body details div dl fieldset footer form header html main nav ol section table td th ul".split())
#: Elements that are never main text, and words of ids, classes and roles that say the same.
BOILERPLATE = frozenset("aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object script select style svg template textarea title video".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
#: Words that say nothing beside another.
FILLERS = frozenset("area bar block box button buttons container icons inner item items link links list outer section wrap wrapper".split())
#: Elements that hold a page's parts and are walked into, and those that head a part.
HOLDERS = frozenset("html body main article section div center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")
_NAMES = re.compile(r"[^a-z]+")

LEAST_PAGES = 3  # pages of a type that a text is on if it is template; tags need but one
LEAST_SHARE = 0.2  # of the type's pages that a template token is on
MINOR = 0.2  # of the article's text that a part of it holds at most if the words of its class can tell it is none
MOST_BROADCAST = 8 << 20  # bytes of templates up to which tasks get them all
SALTS = 64


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Block:
    """A run of text without a block element inside: whole text, characters in links, where it lies, and after how many tags."""

    __slots__ = ("banned", "path", "text", "linked", "at")

    def __init__(self, text: str, linked: int, path: str, banned: bool, at: int = 0):
        self.text, self.linked, self.path, self.banned, self.at = text, linked, path, banned, at


def _kind(name: str, attributes: str) -> tuple[str, bool]:
    """An element's name in paths, its words behind it, and whether it is never main text."""
    label = name
    if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "hidden" in attributes):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role"):
                for own in "".join(values).lower().split():
                    label += "." + "-".join(w for w in _NAMES.split(own) if w)
            elif key == "hidden":
                return label, True
    return label, name in BOILERPLATE


def _words(label: str) -> list[list[str]]:
    """The classes and ids of a path's element, each in its words."""
    return [w.split("-") for w in label.split(".")[1:] if w]


def named_main(label: str) -> bool:
    return label.partition(".")[0] in ("article", "main") or any(w in MAIN_WORDS for words in _words(label) for w in words)


def named_boilerplate(label: str) -> bool:
    """Whether a whole class, not one word of it, names boilerplate."""
    return any(all(w in BOILERPLATE_WORDS | FILLERS for w in words) and BOILERPLATE_WORDS & set(words) for words in _words(label))


def parse(page: str) -> tuple[list[Block], list[str]]:
    """The text blocks of a page in order, and the paths of its tags.

    Unclosed elements end with their parents, stray end tags are left out, a page may end anywhere."""
    blocks: list[Block] = []
    tags: list[str] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # name, path, banned
    parts: list[str] = []
    linked, links, at, size = 0, 0, 0, len(page)

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(raw)

    def end_block() -> None:
        nonlocal linked
        if parts:
            own = " ".join(entities.unescape("".join(parts)).split())
            if own:
                _, path, banned = stack[-1]
                blocks.append(Block(own, linked, path, banned, len(tags)))
            parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal links
        links -= sum(name == "a" for name, *_ in stack[depth:])
        del stack[depth:]

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[2] is None and m[0][-1:] != ">":
            break  # the page ends inside a tag
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if k:
                if name in BLOCK or any(s[0] in BLOCK for s in stack[k:]) or any(s[2] for s in stack[k:]) != stack[k - 1][2]:
                    end_block()
                leave(k)
            elif name in ("p", "br"):
                end_block() if name == "p" else text(" ")
            continue
        if name == "br":
            text(" ")
            continue
        ends = CLOSES.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    end_block()
                    leave(k)
                    if name != "tr":
                        break
                elif stack[k][0] in SCOPE:
                    break
        _, path, banned = stack[-1]
        label, own_banned = _kind(name, m[3] or m[6] or "")
        if name in BLOCK or own_banned != banned and own_banned:
            end_block()
        own = f"{path}/{label}"
        tags.append(own)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        stack.append((name, own, banned or own_banned))
        links += name == "a"
    end_block()
    return blocks, tags


def tag_token(path: str) -> int:
    """Even, unlike those of texts."""
    return hashed(path) & ~1


def text_token(block: Block) -> int:
    return hashed(f"{block.path}\0{block.text}") | 1


def tokens_of(blocks: list[Block], tags: list[str]) -> list[int]:
    """All tokens of a page in order."""
    out, b = [], 0
    for k, path in enumerate(tags):
        while b < len(blocks) and blocks[b].at <= k:
            out.append(text_token(blocks[b]))
            b += 1
        out.append(tag_token(path))
    return out + [text_token(x) for x in blocks[b:]]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def type_of(tags: list[str]) -> int:
    """A page's type: its elements down to those below the body, whatever their number and order."""
    return hashed("\0".join(sorted({t for t in tags if t.count("/") <= 3})))


#: Columns of a parsed page: its distinct tokens in order of their first places, how often each comes, and its blocks.
PARSED = {"tokens": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "texts": pa.list_(pa.string()), "paths": pa.list_(pa.string()), "linked": pa.list_(pa.int64()), "banned": pa.list_(pa.bool_())}
BLOCKS = ["texts", "linked", "paths", "banned"]


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host (with the page's type behind it) and the columns ``PARSED`` of pages (page_id, url, host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in PARSED]
            hosts = []
            for page, host in zip(batch.column("html"), batch.column("host").to_pylist(), strict=True):
                blocks, tags = parse(page.as_py() or "")
                hosts.append(f"{host} {type_of(tags):x}")
                seen: dict[int, int] = {}
                for t in tokens_of(blocks, tags):
                    seen[t] = seen.get(t, 0) + 1
                for col, value in zip(cols, (list(seen), list(seen.values()), *([getattr(b, x) for b in blocks] for x in ("text", "path", "linked", "banned"))), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), *(pa.array(c, t) for c, t in zip(cols, PARSED.values(), strict=True))], ["page_id", "url", "host", *PARSED])

    return pages.mapInArrow(run, "page_id long, url string, host string, tokens array<long>, counts array<long>, texts array<string>, paths array<string>, linked array<long>, banned array<boolean>")


def _with_host(rows: DataFrame, by_host: DataFrame, size: Column) -> DataFrame:
    """``rows`` with the columns of ``by_host`` (a stored row per host), without gathering a large host's rows."""
    if (by_host.agg(F.sum(size)).first()[0] or 0) <= MOST_BROADCAST:
        return rows.join(F.broadcast(by_host), "host", "left")
    copies = by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", (F.rand(5) * SALTS).cast("int")).join(copies, ["host", "__salt"], "left").drop("__salt")


def templates(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """host, token, once (it never comes twice on a page): the tokens of valid nested classes. parsed: host, tokens, counts."""
    shapes = parsed.groupBy("host", "tokens", "counts").agg(F.count("*").alias("pages"))
    shapes = scratch.stored(shapes.withColumn("shape", F.xxhash64("host", "tokens", "counts")), "shapes")
    hosts = shapes.groupBy("host").agg(F.sum("pages").alias("host_pages"))
    spread = shapes.select("host", "shape", "pages", F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    part = F.xxhash64("shape", "x.counts").cast("decimal(20,0)")
    vectors = spread.groupBy("host", F.col("x.tokens").alias("token")).agg(F.sum(part).alias("vector"), F.sum("pages").alias("support"), F.max("x.counts").alias("times"))
    vectors = vectors.join(hosts, "host").where(((F.col("support") >= LEAST_PAGES) | (F.col("token") % 2 == 0)) & (F.col("support") >= F.col("host_pages") * LEAST_SHARE))
    # the frame: tokens on most pages of the host; other classes nest in its gaps
    most = vectors.groupBy("host").agg(F.max("support").alias("most"))
    named = vectors.groupBy("host", "vector", "support").agg(F.collect_list("token").alias("tokens"), F.min("token").alias("cls"), F.max("times").alias("times")).join(most, "host")
    # a row per host: at most 1 / LEAST_SHARE times the tokens of a page are frequent
    listed = [F.flatten(F.collect_list(x)).alias(c) for c, x in (("known", F.col("tokens")), ("known_cls", F.expr("transform(tokens, t -> cls)")), ("framed", F.expr("transform(tokens, t -> support = most)")))]
    frequent = scratch.stored(named.groupBy("host").agg(*listed), "frequent")
    times = scratch.stored(named.select("host", "cls", (F.col("times") == 1).alias("once")), "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            held: dict[str, dict] = {}
            for k, (host, tokens) in enumerate(zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
                if host not in held:
                    known, known_cls, framed = (batch.column(c)[k].as_py() or [] for c in ("known", "known_cls", "framed"))
                    held[host] = dict(zip(known, zip(known_cls, framed, strict=True), strict=True))
                cls_of = held[host]
                order: dict[int, list[tuple[int, int, int]]] = {}
                last, any_frame = (0, 0), False
                for t in tokens:
                    if t in cls_of:
                        c, in_frame = cls_of[t]
                        order.setdefault(c, []).append((t, *last))
                        if in_frame:
                            last, any_frame = (c, len(order[c])), True
                for c, own in order.items():
                    ts, parents, gaps = zip(*own, strict=True)
                    found.add((host, c, ts, parents if any_frame else None, gaps if any_frame else None))
            found = list(found)
            types = [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            names = ["host", "cls", "ordered", "parents", "gaps"]
            yield pa.RecordBatch.from_arrays([pa.array([list(f[k]) if k > 1 and f[k] is not None else f[k] for f in found], t) for k, t in enumerate(types)], names)

    placed = _with_host(shapes.select("host", "tokens"), frequent, F.size("known") * 17 + 64)
    seen = placed.mapInArrow(run, "host string, cls long, ordered array<long>, parents array<long>, gaps array<long>")
    # pages without the frame say nothing about nesting
    lies = F.when(F.col("gaps").isNotNull(), F.struct(F.col("parents")[F.col("place")].alias("parent"), F.col("gaps")[F.col("place")].alias("gap")))
    tokens = seen.select("host", "cls", "parents", "gaps", F.posexplode("ordered").alias("place", "token")).select("host", "cls", "place", "token", lies.alias("lies"))
    tokens = tokens.groupBy("host", "cls", "token").agg((F.min("place") == F.max("place")).alias("in_place"), F.coalesce(F.min("lies") == F.max("lies"), F.lit(True)).alias("nests"))
    nested = tokens.where("in_place").groupBy("host", "cls").agg(F.min("nests").alias("nests"), F.collect_list("token").alias("tokens")).where("nests")
    return nested.join(times, ["host", "cls"]).select("host", F.explode("tokens").alias("token"), "once")


def slot_of(path: str, template: set[int]) -> str:
    """The path of the innermost template tag around a block; empty if none."""
    while path and tag_token(path) not in template:
        path = path.rpartition("/")[0]
    return path


def slot_mass(blocks: list[Block], template: set[int]) -> dict[str, int]:
    """Characters outside links, less those inside, by slot; blocks that are never main text, and the template's own texts, have none."""
    out: dict[str, int] = {}
    for b in blocks:
        if not b.banned and text_token(b) not in template:
            slot = slot_of(b.path, template)
            out[slot] = out.get(slot, 0) + len(b.text) - 2 * b.linked
    return out


def _name(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def article_slots(mass: dict[str, int], once: set[int], pages: int) -> tuple[str, list[str]]:
    """The slot of a template that holds the article, empty if there is none below the body, and further ones that go with it.

    mass: text by slot over all pages; once: the template's tags that come once on a page; pages: how many there are."""
    clear = 2 if pages >= LEAST_PAGES else 4  # a lead that less than this part of the text is left against is no tie
    at, beside = "", []
    whole = sum(max(n, 0) for n in mass.values())
    while True:
        # what each next slot on the way down holds
        below: dict[str, int] = {}
        for path, n in mass.items():
            if n > 0 and path.startswith(at + "/"):
                step = at
                for label in path[len(at) + 1 :].split("/"):
                    step += "/" + label
                    if tag_token(step) in once and label.partition(".")[0] in HOLDERS:
                        below[step] = below.get(step, 0) + n
                        break
        if not below:
            break
        best = max(below, key=lambda x: (below[x], named_main(x.rpartition("/")[2]), x))
        if clear * (whole - below[best]) >= whole:  # a tie: one that is named the article may be it
            named = [x for x in below if named_main(x.rpartition("/")[2]) and (4 * below[x] > whole or pages < LEAST_PAGES)]
            if named:
                best = max(named, key=lambda x: (_name(x) in ("article", "main"), below[x], x))
            elif 2 * below[best] <= whole:
                break
        if _name(best) not in ("html", "body"):
            others = [x for x in mass if x.startswith(at + "/") and not f"{x}/".startswith(best + "/")]
            first = lambda x: x[len(at) + 1 :].partition("/")[0]  # noqa: B023, E731
            beside = [x for x in others if first(x).partition(".")[0] in HEADINGS or named_main(first(x))]
        at, whole = best, below[best]
    return ("", []) if _name(at) in ("", "html", "body") else (at, beside)


def _without_link_lists(blocks: list[Block]) -> list[Block]:
    """``blocks`` but for runs under one element whose text is mostly links: a linked paragraph among others stays."""
    out: list[Block] = []
    for _, run in itertools.groupby(blocks, lambda b: b.path.rpartition("/")[0]):
        own = list(run)
        if 2 * sum(b.linked for b in own) <= sum(len(b.text) for b in own):
            out += own
    return out


def main_blocks(blocks: list[Block], template: set[int], slots: tuple[str, list[str]], mass: dict[str, int]) -> list[str]:
    """The texts that make up a page's article. slots: as ``article_slots`` gives them; mass: the type's text by slot."""
    if not any(slot_of(b.path, template) for b in blocks):
        return [b.text for b in blocks]
    article, beside = slots
    lies_in = lambda b, slot: b.path == slot or b.path.startswith(slot + "/")
    open_ = [b for b in blocks if not b.banned]
    if article and any(lies_in(b, article) for b in blocks):
        least = MINOR * sum(n for x, n in mass.items() if n > 0 and f"{x}/".startswith(article + "/"))
        return [b.text for b in open_ if lies_in(b, article) and not _told_by_words(b.path, article, template, mass, least) or slot_of(b.path, template) in beside]
    # headers of pages are no articles, those of articles are
    open_ = [b for b in open_ if "/header" not in b.path.partition("/article")[0]]
    return [b.text for b in _without_link_lists([b for b in open_ if text_token(b) not in template])]


def _told_by_words(path: str, article: str, template: set[int], mass: dict[str, int], least: float) -> bool:
    """Whether a minor slot inside the article, around this path, has a class that names boilerplate."""
    step = article
    for label in path[len(article) + 1 :].split("/"):
        step += "/" + label
        if named_boilerplate(label) and tag_token(step) in template:
            return sum(n for x, n in mass.items() if n > 0 and f"{x}/".startswith(step + "/")) <= least
    return False


def _per_host(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[list[Block], list]]:
    """The blocks of each page of a batch, and its host's values of ``columns``, decoded once a host."""
    held: dict[str, list] = {}
    for k, host in enumerate(batch.column("host").to_pylist()):
        if host not in held:
            held[host] = [batch.column(c)[k].as_py() or [] for c in columns]
        texts, linked, paths, banned = (batch.column(c)[k].as_py() for c in BLOCKS)
        yield [Block(*x) for x in zip(texts, linked, paths, banned, strict=True)], held[host]


def _host_mass(parsed: DataFrame) -> DataFrame:
    """host, slot (its path), mass: text by slot over all pages of a host and type. parsed: host, blocks, template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], int] = {}
            sets: dict[str, set[int]] = {}
            for host, (blocks, (template,)) in zip(batch.column("host").to_pylist(), _per_host(batch, "template"), strict=True):
                for slot, n in slot_mass(blocks, sets.setdefault(host, set(template))).items():
                    total[host, slot] = total.get((host, slot), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["host", "slot", "mass"])

    return parsed.mapInArrow(run, "host string, slot string, mass long").groupBy("host", "slot").agg(F.sum("mass").alias("mass"))


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of every page of ``pages`` (page_id, url, html; other columns are left out).

    page_id, url, text (blocks joined by a line feed; empty if there are none) and n_chars.
    The template of a host's pages of one type, of however few, names the slots of a page; the slots' text over all of
    these pages tells which is the article. A text is template only if it is on
    ``LEAST_PAGES`` pages, and a token only if it is on ``LEAST_SHARE`` of the pages.
    Null html is empty, a null url is a host of its own, repeated rows repeat, an empty table
    gives an empty result."""
    arrow_limits(pages.sparkSession)
    scratch = Scratch()
    parsed = stored(_parsed(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")), "parsed")
    tokens = F.collect_list("token").alias("template"), F.collect_list(F.when(F.col("once"), F.col("token"))).alias("once")
    counts = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    by_host = scratch.stored(counts.join(templates(parsed, scratch).groupBy("host").agg(*tokens), "host", "left"), "templates")
    size = F.greatest(F.size("template"), F.lit(0)) * 8 + 64
    mass = _host_mass(_with_host(parsed.select("host", *BLOCKS), by_host, size).select("host", *BLOCKS, "template"))
    # a row per host and type: slots are tags of its template
    mass = mass.groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("mass").alias("masses"))
    by_host = stored(by_host.join(mass, "host", "left"), "hosts")
    scratch.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = [], {}
            for host, (blocks, (template, once, slots, masses, pages)) in zip(batch.column("host").to_pylist(), _per_host(batch, "template", "once", "slots", "masses", "pages"), strict=True):
                if host not in sets:
                    by_slot = dict(zip(slots, masses, strict=True))
                    sets[host] = set(template), article_slots(by_slot, set(once), pages), by_slot
                texts.append("\n".join(main_blocks(blocks, *sets[host])))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    rows = _with_host(parsed.select("page_id", "url", "host", *BLOCKS), by_host, F.greatest(F.size("template"), F.lit(0)) * 16 + F.greatest(F.size("slots"), F.lit(0)) * 80 + 64)
    return rows.select("page_id", "url", "host", *BLOCKS, "template", "once", "slots", "masses", "pages").mapInArrow(run, "page_id long, url string, text string, n_chars long")
