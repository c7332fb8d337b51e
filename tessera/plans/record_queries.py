"""Queries over records and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import records as ops
from tessera.plans.registry import query
from tessera.plans.views import view, with_views


@query(
    with_views(
        """WITH a AS (SELECT accession, parent AS ancestor, 1 AS distance FROM hierarchy WHERE parent IS NOT NULL),
b AS (SELECT a.accession, h.parent AS ancestor, 2 AS distance FROM a JOIN hierarchy h ON h.accession = a.ancestor WHERE h.parent IS NOT NULL),
c AS (SELECT b.accession, h.parent AS ancestor, 3 AS distance FROM b JOIN hierarchy h ON h.accession = b.ancestor WHERE h.parent IS NOT NULL)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
        "hierarchy",
    )
)
def record_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ancestors(view(spark, sf_dir, "hierarchy"))


@query(
    with_views(
        """SELECT h.accession, CASE h.level WHEN 'sample' THEN h.accession WHEN 'experiment' THEN h.parent WHEN 'run' THEN e.parent END AS ancestor
FROM hierarchy h LEFT JOIN hierarchy e ON h.level = 'run' AND e.accession = h.parent""",
        "hierarchy",
    )
)
def record_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ancestor_at(view(spark, sf_dir, "hierarchy"), "sample")


def _files(spark: SparkSession, sf_dir: str, claimed: bool) -> DataFrame:
    """Runs are customers; every third file comes without a usable accession and is claimed by name."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    run = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    files = customers.select(F.concat("c_name", F.lit(".fq")).alias("file"), F.when(F.col("c_custkey") % 3 != 0, run).alias("accession"))
    runs = customers.select(run.alias("run"), F.concat("c_name", F.lit(".fq")).alias("filename"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("sample"))
    return ops.files_to_samples(files, runs if claimed else runs.where(F.col("run") != "C3"))


@query("SELECT c_name || '.fq' AS file, 'C' || CAST(c_custkey AS VARCHAR) AS run, 'N' || CAST(c_nationkey AS VARCHAR) AS sample, false AS refused FROM customer")
def files_to_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, True)


@query("SELECT c_name || '.fq' AS file, CASE WHEN c_custkey <> 3 THEN 'C' || CAST(c_custkey AS VARCHAR) END AS run, CASE WHEN c_custkey <> 3 THEN 'N' || CAST(c_nationkey AS VARCHAR) END AS sample, true AS refused FROM customer")
def files_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, False)


@query(
    with_views(
        """WITH r AS (SELECT *, CASE basis WHEN 'observed' THEN 3 WHEN 'user_confirmed' THEN 2 WHEN 'asserted' THEN 1 ELSE 0 END AS rank FROM claims),
t AS (SELECT *, max(rank) OVER (PARTITION BY subject, attribute) AS top FROM r),
s AS (SELECT *, bool_or(declared) OVER (PARTITION BY subject, attribute, source) AS spoken FROM t WHERE rank = top)
SELECT subject, attribute, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, min(basis) AS basis, CASE WHEN count(DISTINCT value) = 1 THEN 'decided' ELSE 'conflict' END AS outcome
FROM s WHERE declared OR NOT spoken GROUP BY subject, attribute""",
        "claims",
    )
)
def decided_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.decided_values(view(spark, sf_dir, "claims"))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) t WHERE k = 1")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars", F.md5("text").alias("content"))
    return ops.first_per_key(docs, ["content"], [F.col("doc_id")]).drop("content")


SKELETON = r"""WITH t AS (SELECT id, regexp_replace({text}, '[\p{{L}}\p{{N}}_]+', chr(1), 'g') AS s, regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+') AS tok FROM {table} WHERE {text} IS NOT NULL),
g AS (SELECT s, count(*) AS members, min(id) AS exemplar FROM t GROUP BY s HAVING count(*) > 1),
p AS (SELECT t.s, i - 1 AS place FROM t JOIN g USING (s), unnest(range(1, len(tok) + 1)) AS u(i) GROUP BY t.s, i HAVING min(tok[i]) <> max(tok[i])),
v AS (SELECT s, list_sort(list(place)) AS v FROM p GROUP BY s)
SELECT id, exemplar, members, array_to_string(v, ',') AS varying, array_to_string(list_transform(v, lambda k: tok[k + 1]), ' ') AS own FROM t JOIN g USING (s) JOIN v USING (s)"""


@query(with_views(SKELETON.format(text="text", table="cards"), "cards"))
def skeleton_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.skeleton_groups(view(spark, sf_dir, "cards"))


@query(SKELETON.format(text="text", table="(SELECT doc_id AS id, text FROM documents)"))
def document_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.skeleton_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))


@query(
    r"""WITH d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM documents),
b AS (SELECT list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM benchmark),
k AS (SELECT DISTINCT array_to_string(w[i:i + 6], ' ') AS s FROM b, unnest(range(1, len(w) - 5)) AS u(i)),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 6], ' ') AS s FROM d, unnest(range(1, len(w) - 5)) AS u(i)),
n AS (SELECT id, count(*) AS n, count(k.s) AS shared FROM s LEFT JOIN k USING (s) GROUP BY id)
SELECT id, n, shared, shared / n AS rate FROM n WHERE shared > 0"""
)
def shared_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return ops.shared_shingles(docs, items, 7)


@query(
    r"""WITH b AS (SELECT source || ':' || CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS VARCHAR) AS batch, doc_id, regexp_replace(text, '^[^\p{L}\p{N}_]+', '') AS t FROM documents),
w AS (SELECT batch, doc_id, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w, regexp_extract_all(t, '[^\p{L}\p{N}_]+') AS g FROM b),
s AS (SELECT DISTINCT batch, doc_id, w[i] || g[i] || w[i + 1] || g[i + 1] || w[i + 2] || g[i + 2] || w[i + 3] AS s FROM w, unnest(range(1, len(w) - 2)) AS u(i)),
c AS (SELECT batch, s, count(*) AS n FROM s GROUP BY batch, s),
n AS (SELECT batch, sum(n) AS n_spans, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS n_ambiguous FROM c GROUP BY batch)
SELECT d.batch, d.n_documents, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CAST(coalesce(n_ambiguous, 0) AS BIGINT) AS n_ambiguous
FROM (SELECT batch, count(*) AS n_documents FROM b GROUP BY batch) d LEFT JOIN n USING (batch)"""
)
def quote_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of eight documents of one source each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    order = docs.select("source", "doc_id", place.alias("place"))  # ranks without the texts
    batch = F.concat("source", F.lit(":"), F.floor((F.col("place") - 1) / 8).cast("string"))
    batches = order.select("doc_id", batch.alias("batch"))
    return ops.quote_residue(docs.select("doc_id", "text").join(batches, "doc_id").select("batch", F.col("doc_id").alias("id"), "text"))


@query(
    """WITH n AS (SELECT lower(p_type) AS attribute, lower(p_brand) || CAST(p_size AS VARCHAR) AS synonym FROM part UNION ALL SELECT lower(p_type), lower(p_name) FROM part),
own AS (SELECT DISTINCT attribute AS key, attribute FROM n)
SELECT * FROM own UNION ALL SELECT synonym, min(attribute) FROM n WHERE synonym NOT IN (SELECT key FROM own) GROUP BY synonym HAVING count(DISTINCT attribute) = 1"""
)
def unambiguous_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.lower("p_type").alias("attribute")
    names = part.select(kind, F.concat(F.lower("p_brand"), F.col("p_size").cast("string")).alias("synonym")).union(part.select(kind, F.lower("p_name")))
    return ops.unambiguous_synonyms(names)


@query(
    """WITH p AS (SELECT DISTINCT string_split('s' || CAST(o_custkey AS VARCHAR) || '_L' || CAST(o_orderkey % 4 AS VARCHAR) || '_' || o_orderstatus, '_') AS p FROM orders),
b AS (SELECT p, i - 1 AS place, p[i] AS token FROM p, unnest(range(1, len(p) + 1)) AS u(i))
SELECT array_to_string(list_transform(p, lambda x, j: CASE WHEN j - 1 = place THEN '*' ELSE x END), '_') AS key, CAST(place AS INTEGER) AS place, count(DISTINCT token) AS n FROM b GROUP BY 1, 2 HAVING count(DISTINCT token) > 1"""
)
def differing_at_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit("s"), F.col("o_custkey").cast("string"), F.lit("_L"), (F.col("o_orderkey") % 4).cast("string"), F.lit("_"), "o_orderstatus")
    return ops.differing_at_one(orders.select(name.alias("name")), "name")


@query(
    """WITH e AS (SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey % 5 <> 0),
a AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE o_orderpriority END AS value FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(e.key, a.key) AS key, e.value AS expected, a.value AS actual, CASE WHEN a.key IS NULL THEN 'missing' WHEN e.key IS NULL THEN 'orphan' ELSE 'mismatch' END AS finding
FROM e FULL JOIN a ON e.key = a.key WHERE a.key IS NULL OR e.key IS NULL OR e.value IS DISTINCT FROM a.value"""
)
def compare_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    expected = orders.where(key % 5 != 0).select(key.alias("key"), F.col("o_orderpriority").alias("value"))
    actual = orders.where(key % 7 != 0).select(key.alias("key"), F.when(key % 11 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("value"))
    return ops.compare_parameters(expected, actual)


@query("SELECT o_custkey, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM (SELECT o_custkey, sha256(CAST(o_orderkey AS VARCHAR) || chr(9) || o_orderstatus) AS h FROM orders) t GROUP BY o_custkey")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.content_hash(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], ["o_orderkey", "o_orderstatus"])
