"""Near-dedup keeps one row of each group, whatever the rows' ids."""

from __future__ import annotations

from tests.llm.conftest import SCHEMA
from tessera.llm.minhash import drop_near_duplicates


def test_one_row_of_each_group(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows = [(3, x), (7, x), (7, y), (9, y), (7, y), (None, z), (None, z + " end"), (None, y), (5, ""), (5, ""), (None, None), (11, "one word"), (11, "one word")]
    docs = spark.createDataFrame([(i, t, None, 0, 0, "r", None) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()]
    (last,) = [r for r in got if r[1] and r[1].startswith("z")]
    assert last[0] is None
    assert sorted((r for r in got if r != last), key=repr) == sorted([(3, x), (7, y), (5, ""), (5, ""), (None, None), (11, "one word")], key=repr)


def test_equal_ids_and_texts_with_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, lang, 0, 0, "r", key) for lang, key in (("en", None), (None, "en"), ("en", None))], SCHEMA)
    assert drop_near_duplicates(docs).count() == 1
