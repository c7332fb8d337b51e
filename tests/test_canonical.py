from __future__ import annotations

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import canonical
from tessera.plans import registry

SCHEMA = "c struct<name:string, n:long, x:double, ok:boolean, tags:array<string>, deep:struct<b:array<struct<k:int>>, a:map<string,long>, note:string>>"


def contents(n):
    rng = random.Random(n)
    words = ["plain", 'q"uo\\te', "tab\t\n\r\b\f", "é漢🙂", "\u007f\u0001", "", None, "/"]
    numbers = [0.0, -0.0, 1.0, 0.1, 1e16, 1e-5, 123456789.125, 1e7, 1e22, 2.5e-300, None, 711.56]
    for _ in range(n):
        deep = {"b": rng.choice([None, [], [{"k": 1}, None, {"k": None}]]), "a": rng.choice([None, {}, {"z": 1, "b": None, "é": -4}]), "note": rng.choice(words)}
        yield {"name": rng.choice(words), "n": rng.choice([None, 0, -5, 1 << 60]), "x": rng.choice(numbers), "ok": rng.choice([None, True, False]), "tags": rng.choice([None, [], ["b", None, "a"]]), "deep": rng.choice([None, deep, deep])}


def nested(c):
    if c is None:
        return None
    deep = c["deep"] and Row(b=c["deep"]["b"] and [k and Row(k=k["k"]) for k in c["deep"]["b"]] or c["deep"]["b"], a=c["deep"]["a"], note=c["deep"]["note"])
    return Row(name=c["name"], n=c["n"], x=c["x"], ok=c["ok"], tags=c["tags"], deep=deep)


def test_json_and_hash_equal_the_reference_form(spark):
    given = list(contents(150))
    rows = spark.createDataFrame([(nested(c),) for c in given], SCHEMA)
    kind = rows.schema["c"].dataType
    got = [r[0] for r in rows.select(canonical.canonical_json(F.col("c"), kind)).collect()]
    assert got == [json.dumps(c, sort_keys=True, separators=(",", ":")) for c in given]
    hashed = canonical.with_content_hash(rows, "c", ["x", "deep.note"]).collect()
    for c, r in zip(given, hashed, strict=True):
        kept = {k: v for k, v in c.items() if k != "x"} | {"deep": c["deep"] and {k: v for k, v in c["deep"].items() if k != "note"}}
        assert r.content_hash == hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_runs_and_refusals(spark):
    one = spark.range(1).select(canonical.run_id(F.lit("d"), F.lit("p"), F.lit("s"), F.lit("1")).alias("r")).first().r
    assert one == hashlib.sha256(b"d|proc=p|spec=s|wf=1").hexdigest()
    with pytest.raises(ValueError, match="doubles"):
        canonical.with_content_hash(spark.createDataFrame([], "c struct<x:array<double>>"), "c")


def test_hashes_of_odd_customers_equal_their_sql(spark, tmp_path):
    rng = random.Random(2)
    numbers = [-0.0, 0.0, None, -5.0, 1e7, 1e15, 0.01, -0.29, 1e-5, 1e-7, 123456789.125, 0.1 + 0.2, 2.0 / 3]
    given = [(rng.choice([k, k, k, -k, None]), rng.choice([f"Customer#{k}", f"Customer#{k}", None]), rng.choice([*range(25), None]), numbers[k % len(numbers)], rng.choice(["FURNITURE", "MACHINERY", None])) for k in range(200)]
    path = f"{tmp_path}/customer.parquet"
    spark.createDataFrame(given, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    got = registry.QUERIES["content_hashes"](spark, str(tmp_path)).select("id", "content_hash", "run_id").collect()
    want = db.sql(f"SELECT id, content_hash, run_id FROM ({registry.ORACLE_SQL['content_hashes']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.content_hash is None for r in got} == {True, False}
