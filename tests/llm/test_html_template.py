"""Operator 6: templates against brute force over whole hosts, and what the template decides."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.html import LEAST_PAGES, LEAST_SHARE, _parsed, article_slots, extract_text, host_of, main_blocks, parse, slot_mass, tag_token, templates, tokens_of, type_of

LONG = "a sentence of the article that goes on for a while"


def brute_template(pages):
    """Tokens of valid nested classes of one host's pages of one type, from the definition, and whether they come once."""
    seqs = [tokens_of(*parse(p)) for p in pages]
    first = [list(dict.fromkeys(s)) for s in seqs]
    vectors = {t: tuple(s.count(t) for s in seqs) for s in seqs for t in s}
    support = {t: sum(n > 0 for n in v) for t, v in vectors.items()}
    ok = {t for t, n in support.items() if (n >= LEAST_PAGES or t % 2 == 0) and n >= LEAST_SHARE * len(pages)}
    most = max((support[t] for t in ok), default=0)
    classes = defaultdict(list)
    for t in ok:
        classes[vectors[t]].append(t)
    frame = {t for t in ok if support[t] == most}
    out = set()
    for v, members in classes.items():
        places, lies = defaultdict(set), defaultdict(set)
        for s in first:
            before, place = None, 0
            framed = any(t in frame for t in s)
            for t in s:
                if t in members:
                    places[t].add(place)
                    place += 1
                    if framed:
                        lies[t].add(before)
                if t in frame:
                    before = t
        stay = [t for t in members if len(places[t]) == 1]
        if all(len(lies[t]) <= 1 for t in stay):
            out.update(stay)
    return {t: max(vectors[t]) == 1 for t in out}


def types(rows):
    """Pages by host and type."""
    out = defaultdict(list)
    for _, url, text in rows:
        host = re.sub(r"http://([^/]*).*", r"\1", url or "")
        out[f"{host} {type_of(parse(text or '')[1]):x}"].append(text or "")
    return out


def hosts():
    page = "<html><body><nav><a>{m}</a></nav>{ad}<div id=c><h2>{k}</h2>{body}</div>{note}<div class=foot>All rights are ours</div>"
    rows = []
    for h in range(6):
        for k in range(1 + 3 * h):
            ad = "<p class=x>Buy this now</p>" if (k + h) % 3 else ""
            body = "".join(f"<p>{k} {j} {LONG}</p>" for j in range(1 + k % 4)) + ("<ul><li>x<li>y</ul>" if k % 5 == 1 else "")
            note = "<section><p>Same note</p></section>" if k % 2 else ""
            one = page.format(m=k, ad=ad if h != 4 or k % 2 else "", k=k, body=body, note=note) + (ad if h == 4 and not k % 2 else "")
            rows.append((len(rows), f"http://h{h}.example/{k}", one))
    return rows


def test_templates_equal_brute_force(spark):
    rows = hosts() + [(1000, None, "<p>alone"), (1001, "http://z.example", ""), (1002, "http://z.example", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    got = defaultdict(dict)
    for r in templates(_parsed(pages), Scratch()).collect():
        got[r.host][r.token] = r.once
    assert dict(got) == {h: t for h, t in ((h, brute_template(p)) for h, p in types(rows).items()) if t}


def test_mass_of_a_host_is_added_over_its_pages(spark):
    from tessera.llm import html as operator

    rows = hosts()
    parsed = _parsed(spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", "url", host_of(F.col("url")).alias("host"), "html"))
    template = {h: set(brute_template(p)) for h, p in types(rows).items()}
    by_host = spark.createDataFrame([(h, sorted(t)) for h, t in template.items()], "host string, template array<long>")
    got = {(r.host, r.slot): r.mass for r in operator._host_mass(parsed.join(by_host, "host").select("host", *operator.BLOCKS, "template")).collect()}
    want = defaultdict(int)
    for h, pages in types(rows).items():
        for p in pages:
            for slot, n in slot_mass(parse(p)[0], template[h]).items():
                want[h, slot] += n
    assert got == dict(want)


def plain_article(page):
    """The blocks of the given tables' articles, which hold h1, p, b and br alone."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", inner))
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, table):
    pages = spark.read.parquet(f"/root/testdata/{table}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert got == {r.page_id: (t := plain_article(r.html), len(t)) for r in pages.collect()}


def by_steps(pages, only=None):
    """Texts of (url, html) by the operator's own steps, one after the other; ``only`` cuts the template down to these paths."""
    out = {}
    for host, own in types([(0, u, h) for u, h in pages]).items():
        found = brute_template(own)
        if only is not None:
            found = {t: once for t, once in found.items() if t in only}
        mass = defaultdict(int)
        for p in own:
            for slot, n in slot_mass(parse(p)[0], set(found)).items():
                mass[slot] += n
        slots = article_slots(mass, {t for t, once in found.items() if once}, len(own))
        out |= {(host, p): "\n".join(main_blocks(parse(p)[0], set(found), slots, mass)) for p in own}
    return list(out.values())


def test_the_template_decides_on_given_pages(spark):
    """Cut down to html and body, it gives another text on every page; names of classes and of the article's element change none."""
    pages = [(r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    want = sorted(plain_article(h) for _, h in pages)
    assert sorted(by_steps(pages)) == want
    bare = {tag_token(t) for _, h in pages for t in parse(h)[1] if t.count("/") <= 2}
    cut = by_steps(pages, bare)
    assert not set(cut) & set(want)
    renamed = [(u, re.sub(r"<(/?)article", r"<\1div", h.replace('class="ad"', 'class="vq"'))) for u, h in pages]
    assert len(set(by_steps(renamed)) - set(want)) <= 2  # short articles, alone of their hosts, had but their names


def test_the_host_tells_which_slot_is_the_article(spark):
    """A page with a short article and a long text elsewhere follows its host's other pages."""
    page = "<body><article><p>{a}</p></article><div class=x><p>{b}</p></div>"
    rows = [(k, f"http://h.example/{k}", page.format(a=f"{k} {LONG} " * 9, b=f"side {k}")) for k in range(6)]
    rows += [(9, "http://h.example/9", page.format(a="Short news", b=f"{LONG} " * 5)), (10, "http://other.example/9", page.format(a="Short news", b=f"{LONG} " * 5))]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short news"
    assert got[10] == "Short news\n" + " ".join([LONG] * 5)  # nothing but this page tells of its host
