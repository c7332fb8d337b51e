"""Decontamination, HTML extraction, licence scans and language identification."""

from __future__ import annotations

import hashlib
import random
import re

from tessera.llm import decontam
from tessera.llm.decontam import contamination, drop_contaminated
from tessera.llm.html import extract_text, parse
from tessera.llm.langid import features, fit_languages, identify_languages, keep_identified
from tessera.llm.licenses import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(text, items):
    own, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        w = words_of(item)
        n = min(10, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(own) - n + 1 if n else 0):
            if tuple(own[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add("" if item_id is None else str(item_id))
    ids = ",".join(sorted(found))
    return len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def items_for(rows):
    rng = random.Random(3)
    long = rows[16][1].split()
    return [(1, " ".join(long[100:130])), (10, "W5, One-two"), (2, " ".join(long[5000:5009])), (3, None), (4, ""), (5, "one"), (5, " ".join(long[29990:])), (6, " ".join(f"w{rng.randrange(400)}" for _ in range(25))), (None, "漢字"), (1, " ".join(long[100:130]))]


def test_contamination_equals_brute_force(spark, docs, rows, none):
    items = items_for(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs, bench).collect()
    want = [(i if i is not None else -1, *brute_contamination(t, items)) for i, t, *_ in rows]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert any(w[-1] for w in want)
    assert contamination(none, bench).collect() == []
    assert not any(r.contaminated for r in contamination(docs, bench.limit(0)).collect())
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == sum(not w[-1] for w in want)


def test_contamination_by_random_texts(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = [(k, text(rng.randrange(0, 60))) for k in range(60)]
    items = [(k, text(rng.randrange(0, 14))) for k in range(30)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *brute_contamination(t, items)) for i, t in docs)


def test_contamination_with_more_items_than_tasks_hold(spark, docs, rows, monkeypatch):
    """The other plan for many items gives the same; a stem that many items share gathers ids, no texts."""
    items = items_for(rows)
    stem = " ".join(rows[6][1].split()[:14])
    items += [(100 + k, f"{stem} choice {k} of many ends here") for k in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:])
    one = sorted(key(r) for r in contamination(docs, bench).collect())
    monkeypatch.setattr(decontam, "MOST_HELD", 0)
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    two = sorted(key(r) for r in contamination(docs, bench).collect())
    assert one == two == sorted((i if i is not None else -1, *brute_contamination(t, items)) for i, t, *_ in rows)
    assert max(r[3] for r in one) >= 200


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header>Site</header><nav><a href=/x>menu</a></nav><div class="cookie-notice">We use cookies</div>
<article id="post-7"><h1>Head &amp; <i>line</i></h1><p><b>First&nbsp;one<br>and more.<p>Second  &#233;&lt;p&gt;
<aside>Aside</aside><div class="share-buttons">Share</div><ul><li>a<li>b <b>c</b></ul><table><tr><td>1<td>2</table>
<form><p>Mail</p><input></form><div class="comments"><p>Reader</p></div>tail &am</article>
<div id="sidebar"><p>Side</p></div><footer>&copy; me</footer>"""


def test_article_blocks(spark):
    rows = [(1, "http://a.example/x", PAGE, 1), (2, None, None, 1), (3, "", "", 1), (4, "http://u@a.example:80", "<p>cut <b", 1), (1, "http://a.example/x", PAGE, 1)]
    rows += [(10 + k, f"http://b.example/{k}", f"<body><div class=top>Welcome all</div><div><p>Story {k} is long enough.</p><p><a href=/>read more of this</a></p></div><div>Made by us</div>", 1) for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    assert got[1].text == "Head & line\nFirst one and more.\nSecond é<p>\na\nb c\n1\n2\ntail &am"
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[4].text == "cut"
    for k in range(5):  # the host's template holds the texts that all its pages share
        assert got[10 + k].text == f"Story {k} is long enough."
    assert extract_text(pages.limit(0)).collect() == []
    assert extract_text(pages).count() == len(rows)


def test_parser_takes_anything():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<b>", "</div>", "<div class='x", "\"", "<", ">", "<!--", "-->", "<script>", "</script", "&amp", "text ", "<li>", "<a href=\"", "<![CDATA[", "<br/>", "</", "<textarea>"]
    for _ in range(300):
        parse("".join(rng.choice(parts) for _ in range(rng.randrange(40))))
    parse("<a " * 20000 + "<p" * 20000 + "<div>" * 3000)


def test_licenses(spark, none):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://x"
    rows = [(1, apache), (2, "Text. Released under the MIT License. More"), (3, None), (4, ""), (5, "// SPDX-License-Identifier: BSD-2-Clause OR MIT\nx"), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."), (8, "A driving license is needed."), (2, "Text. Released under the MIT License. More")]
    got = sorted((r.doc_id, r.sentence_ids, r.licenses, r.licensed, r.n_known) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [
        (1, "apache-grant,apache-copy", "Apache-2.0", True, 2), (2, "mit-mention", "MIT", True, 1), (2, "mit-mention", "MIT", True, 1), (3, "", "", False, 0), (4, "", "", False, 0),
        (5, "spdx", "SPDX:BSD-2-Clause OR MIT", True, 1), (6, "GPL-3.0", "GPL-3.0", True, 1), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", True, 1), (8, "", "", False, 0),
    ]
    assert license_scan(none).collect() == []


def test_held_out_accuracy(spark, none, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    sure = sum(r.score for r in got) / len(got)  # calibrated: mean score near accuracy
    assert abs(sure - sum(r.lang == r.lang_pred for r in got) / len(got)) < 0.1
    odd = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert {odd[k].lang_pred for k in (0, 1, 2, 19)} == {"und"} and odd[0].score == 0
    assert all(r.lang_pred == "und" for r in identify_languages(docs.where("lang is null")).collect())
    assert identify_languages(none).collect() == [] and keep_identified(none).columns == docs.columns


def test_language_and_source_do_not_enter_predictions(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    from tessera.llm.langid import held_out, predicted

    model = fit_languages(table.where(~held_out(F.col("doc_id"))))
    twice = table.select("text").union(table.select("text")).select("text", predicted(model, F.col("text")).alias("p")).distinct()
    assert twice.count() == table.select("text").distinct().count()


def test_features_count_ngrams_inside_texts():
    import numpy as np

    raw = [t.encode() for t in ("Ab-c", "", "12", "é")]
    grams, has = features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert has.tolist() == [True, False, False, True]
    assert [np.diff(e).tolist() for _, e in grams] == [[5, 0, 0, 2], [4, 0, 0, 1], [3, 0, 0, 0]]


def test_training_follows_the_update_rule_step_by_step():
    """FTRL-proximal with elastic net, coordinate by coordinate in plain loops."""
    import math

    import numpy as np

    from tessera.llm.langid import BUCKETS, fit_temperature, train_ftrl

    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(3)), np.sort(rng.choice(40, 6, replace=False)), rng.random(6) * 4) for _ in range(25)]
    epochs, alpha, beta, l1, l2, seed = 2, 0.3, 1.0, 0.02, 0.05, 3
    weights, bias = train_ftrl(rows, 3, epochs, alpha, beta, l1, l2, seed)
    z, n = {}, {}

    def weight(k, c):
        a = z.get((k, c), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get((k, c), 0.0))) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, ks, xs = rows[r]
            at = [*zip(ks.tolist(), xs.tolist(), strict=True), (BUCKETS, 1.0)]
            w = {(k, c): weight(k, c) for k, _ in at for c in range(3)}
            odds = [math.exp(sum(x * w[k, c] for k, x in at)) for c in range(3)]
            for k, x in at:
                for c in range(3):
                    g = x * (odds[c] / sum(odds) - (c == y))
                    old = n.get((k, c), 0.0)
                    z[k, c] = z.get((k, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[k, c]
                    n[k, c] = old + g * g
    assert all(abs(weights[k, c] - weight(k, c)) < 1e-9 for k in range(40) for c in range(3))
    assert all(abs(bias[c] - weight(BUCKETS, c)) < 1e-9 for c in range(3)) and not weights[40:].any()

    logits = [(y, np.array([y == 0, y == 1, y == 2]) * 3.0 + rng.random(3) * 4) for y, *_ in rows]
    loss = lambda t: -sum(math.log(math.exp(v[y] / t) / sum(math.exp(x / t) for x in v)) for y, v in logits)
    best = fit_temperature(logits)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 20, 121))


def test_learning_counts_equal_texts_once_and_all_document_frequencies(spark):
    from tessera.llm.langid import _frequencies

    rows = [("aa bb", "x")] * 50 + [("cc", "y"), ("aa", "x"), ("1", "x")]
    got = {(r.lang, r.bucket): r.n for r in _frequencies(spark.createDataFrame(rows, "text string, lang string").repartition(3)).collect()}
    assert (got["x", -1], got["y", -1], got[None, -2]) == (52, 1, 52)
    assert max(n for (lang, b), n in got.items() if b >= 0) == 52  # the space after each run of letters
