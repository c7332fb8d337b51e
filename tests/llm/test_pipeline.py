"""The corpus pipeline on a small table, stage by stage, against brute force; and the queries' SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries
from tests.llm.test_minhash import brute
from tests.llm.test_text_operators import brute_contamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SF)
    assert first.columns == columns
    # real prose in a learned language stays
    assert first.count() >= 0.97 * docs.count()
    known = [(r.doc_id, r.text) for r in first.collect()]
    second = stages["minhash_near_dedup"](spark, spark.createDataFrame(first.collect(), docs.schema), SF)
    assert second.columns == columns
    assert {r.doc_id for r in second.collect()} == {i for i, _, _, keep in brute(known, 80) if keep}
    third = stages["decontamination"](spark, spark.createDataFrame(second.collect(), docs.schema), SF)
    assert third.columns == columns
    kept = {r.doc_id for r in second.collect() if not brute_contamination(r.text, items)[-1]}
    assert {r.doc_id for r in third.collect()} == kept
    packed = stages["packing"](spark, third, SF)
    assert {r.doc_id for r in packed.collect()} == kept
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in packed.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
