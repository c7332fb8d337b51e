"""Queries over near-identical texts and what records declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import variants
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_TOKEN = r"[\p{L}\p{N}_]+"

#: tok: every token and its place; grp: members of groups of two or more; var: the varying tokens of exemplars
GROUPED = rf"""p AS (SELECT id, text, regexp_split_to_array(text, '{_TOKEN}') AS g, regexp_extract_all(text, '{_TOKEN}') AS t FROM cards),
e AS (SELECT id, i - 1 AS place, length(g[i]) AS n, t[i] AS value FROM p, unnest(range(1, len(t) + 1)) AS u(i)),
tok AS (SELECT id, place, CAST(sum(n + length(value)) OVER (PARTITION BY id ORDER BY place) AS BIGINT) AS "end", value FROM e),
k AS (SELECT id, text, g, t, min(id) OVER (PARTITION BY g) AS exemplar, count(*) OVER (PARTITION BY g) AS n FROM p), grp AS (SELECT * FROM k WHERE n > 1),
v AS (SELECT exemplar, place, count(DISTINCT value) AS n_values FROM grp JOIN tok USING (id) GROUP BY exemplar, place),
var AS (SELECT exemplar, place, "end" - length(value) AS start, "end", value, n_values FROM v JOIN tok USING (place) WHERE tok.id = exemplar AND n_values > 1)"""


@query(
    rf"""WITH p AS (SELECT doc_id AS id, regexp_split_to_array(text, '{_TOKEN}') AS g, regexp_extract_all(text, '{_TOKEN}') AS t FROM documents),
e AS (SELECT id, CAST(i - 1 AS INTEGER) AS place, length(g[i]) AS n, t[i] AS value FROM p, unnest(range(1, len(t) + 1)) AS u(i)),
s AS (SELECT id, place, CAST(sum(n + length(value)) OVER (PARTITION BY id ORDER BY place) AS BIGINT) AS "end", value FROM e)
SELECT id, place, "end" - length(value) AS start, "end", value FROM s"""
)
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.token_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))


@query(with_views(f"WITH {GROUPED} SELECT exemplar, CAST(place AS INTEGER) AS place, start, \"end\", value, n_values FROM var", "cards"))
def variant_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_spans(view(spark, sf_dir, "cards"))


@query(
    with_views(
        f"""WITH {GROUPED}, o AS (SELECT grp.id, place, value, g[place + 1] AS gap, lag(place) OVER (PARTITION BY grp.id ORDER BY place) AS before
  FROM grp JOIN tok USING (id) JOIN (SELECT exemplar, place FROM var) x USING (exemplar, place) WHERE grp.id <> exemplar)
SELECT id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before = place - 1 THEN gap ELSE chr(10) || chr(10) END || value, '' ORDER BY place) AS own FROM o GROUP BY id""",
        "cards",
    )
)
def variant_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_texts(view(spark, sf_dir, "cards"))


@query(
    with_views(
        f"""WITH {GROUPED}, ok AS (SELECT * FROM quotes q WHERE doc IN (SELECT exemplar FROM grp) AND NOT EXISTS (SELECT 1 FROM var WHERE exemplar = q.doc AND var.start < q."end" AND q.start < var."end"))
SELECT claim, doc, start, "end", claim IN (SELECT claim FROM ok) AS fanned FROM quotes
UNION ALL SELECT claim, grp.id, instr(text, quote) - 1, instr(text, quote) - 1 + length(quote), true FROM ok JOIN grp ON exemplar = doc WHERE per_record AND grp.id <> exemplar AND contains(text, quote)""",
        "cards", "quotes",
    )
)
def fanned_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variants.fanned_claims(view(spark, sf_dir, "quotes"), view(spark, sf_dir, "cards"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(
    with_views(
        r"""WITH a AS (SELECT c_custkey AS id, 'segment' AS attribute, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'band', c_mktsegment FROM customer),
o AS (SELECT id, attribute, i - 1 AS start, i - 1 + length(value) AS "end", substr(text, i - 1, 2) AS l, substr(text, i + length(value) - 1, 2) AS r, i FROM cards JOIN a USING (id), unnest(range(1, length(text) + 1)) AS u(i) WHERE substr(text, i, length(value)) = value)
SELECT id, start, "end", max(attribute) AS attribute FROM o WHERE NOT (i > 1 AND regexp_full_match(l, '[\p{L}\p{N}_]{2}')) AND NOT regexp_full_match(r, '[\p{L}\p{N}_]{2}') GROUP BY id, "end", start""",
        "cards",
    )
)
def declared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    columns = F.array(*(F.struct(F.lit(name).alias("attribute"), F.col(c).cast("string").alias("value")) for name, c in (("segment", "c_mktsegment"), ("nation", "c_nationkey"), ("band", "c_mktsegment"))))
    return variants.declared_spans(view(spark, sf_dir, "cards"), customer.select(F.col("c_custkey").alias("id"), F.inline(columns)))
