"""Queries over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import intervals as ops
from tessera.plans.registry import query
from tessera.plans.views import view, with_views


@query(
    with_views(
        """WITH s AS (SELECT contig, start, max("end") AS e, count(*) AS n FROM spans WHERE start < "end" GROUP BY contig, start),
b AS (SELECT *, CASE WHEN start > max(e) OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start) AS run FROM b)
SELECT contig, min(start) AS start, max(e) AS "end", CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY contig, run""",
        "spans",
    )
)
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merged(view(spark, sf_dir, "spans"), gap=1)


@query(
    with_views(
        """SELECT a.event_id, b.event_id AS r_event_id, least(a."end", b."end") - greatest(a.start, b.start) AS shared FROM spans a JOIN spans b ON a.contig = b.contig AND a.start < b."end" AND b.start < a."end" AND a.start < a."end" AND b.start < b."end"
WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase'""",
        "spans",
    )
)
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "spans")
    out = ops.overlaps(spans.where("event_type = 'purchase'"), spans.where("event_type <> 'purchase'").select("contig", "start", "end", "event_id"), 400)
    return out.select("event_id", "r_event_id", (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))


@query(
    with_views(
        """WITH e AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, start AS pos, 1 AS d FROM spans WHERE start < "end" UNION ALL SELECT contig, "end", -1 FROM spans WHERE start < "end") GROUP BY contig, pos HAVING sum(d) <> 0),
s AS (SELECT contig, pos AS start, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS "end", CAST(sum(d) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS depth FROM e)
SELECT * FROM s WHERE depth > 0""",
        "spans",
    )
)
def coverage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coverage_steps(view(spark, sf_dir, "spans"))


@query(
    with_views(
        """WITH x AS (SELECT contig, start, "end", event_id % 23 AS gene, event_type FROM spans WHERE start < "end"),
f AS (SELECT event_id AS fragment, contig, start, "end", CASE WHEN event_id % 19 = 0 THEN NULL ELSE 1 + CAST(event_id % 10 = 0 AS BIGINT) END AS hits FROM spans WHERE event_type = 'purchase'),
n AS (SELECT fragment, hits,
  (SELECT count(DISTINCT gene) FROM x WHERE event_type = 'signup' AND x.contig = f.contig AND x.start < f."end" AND f.start < x."end" AND f.start < f."end") AS ne,
  (SELECT min(gene) FROM x WHERE event_type = 'signup' AND x.contig = f.contig AND x.start < f."end" AND f.start < x."end" AND f.start < f."end") AS e,
  (SELECT count(DISTINCT gene) FROM x WHERE event_type IN ('signup', 'error') AND x.contig = f.contig AND x.start < f."end" AND f.start < x."end" AND f.start < f."end") AS nb,
  (SELECT min(gene) FROM x WHERE event_type IN ('signup', 'error') AND x.contig = f.contig AND x.start < f."end" AND f.start < x."end" AND f.start < f."end") AS b FROM f),
r AS (SELECT *, CASE WHEN hits IS NULL THEN 'unmapped' WHEN hits > 1 THEN 'multimapping' WHEN ne = 1 THEN 'exonic' WHEN ne > 1 THEN 'ambiguous' WHEN nb = 1 THEN 'intronic' WHEN nb > 1 THEN 'ambiguous' ELSE 'no_feature' END AS fate FROM n)
SELECT fragment, fate, CASE fate WHEN 'exonic' THEN e WHEN 'intronic' THEN b END AS gene FROM r""",
        "spans",
    )
)
def fragment_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "spans").withColumn("gene", F.col("event_id") % 23)
    hits = F.when(F.col("event_id") % 19 != 0, 1 + (F.col("event_id") % 10 == 0).cast("long"))
    fragments = spans.where("event_type = 'purchase'").select(F.col("event_id").alias("fragment"), "contig", "start", "end", hits.alias("hits"))
    return ops.fragment_fates(fragments, spans.where("event_type = 'signup'"), spans.where("event_type in ('signup', 'error')"), 400)


@query(
    """WITH r AS (SELECT l_suppkey AS barcode, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS reads FROM lineitem),
b AS (SELECT barcode, count(*) AS n, sum(reads) AS reads FROM r GROUP BY barcode)
SELECT CAST(sum(n) AS BIGINT) AS n_fragments, count(*) AS n_barcodes, CAST(sum(reads) AS BIGINT) AS n_reads, max(n) AS max_per_barcode, min(n) AS min_per_barcode,
  CAST(sum(reads) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS reads_per_fragment, CAST(sum(n) AS DOUBLE) / count(*) AS fragments_per_barcode FROM b"""
)
def fragment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    reads = F.when(F.col("l_partkey") % 10 == 0, F.lit("x")).when(F.col("l_partkey") % 5 != 0, F.col("l_quantity").cast("long").cast("string"))
    return ops.fragment_totals(rows.select(F.col("l_suppkey").alias("barcode"), reads.alias("reads")))
