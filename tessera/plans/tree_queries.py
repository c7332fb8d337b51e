"""Queries over trees, gene models and run inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import intervals, trees
from tessera.plans.registry import query
from tessera.plans.views import view, with_views
from tessera.sources.tables import report_files

ROOTED = """r AS (
  SELECT h.accession AS node, coalesce(c.parent, b.parent, a.parent) AS up3, a.parent AS up1, b.parent AS up2 FROM hierarchy h
  LEFT JOIN hierarchy a ON a.accession = h.accession LEFT JOIN hierarchy b ON b.accession = a.parent LEFT JOIN hierarchy c ON c.accession = b.parent),
root AS (SELECT node, coalesce(up3, node) AS root, CASE WHEN up1 IS NULL THEN 0 WHEN up2 IS NULL THEN 1 WHEN up3 = up2 THEN 2 ELSE 3 END AS depth FROM r)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "hierarchy").select(F.col("accession").alias("node"), "parent", "level")


@query(with_views("SELECT accession AS node FROM hierarchy WHERE accession NOT IN (SELECT parent FROM hierarchy WHERE parent IS NOT NULL)", "hierarchy"))
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.leaves(_nodes(spark, sf_dir))


@query(with_views(f"WITH {ROOTED} SELECT * FROM root", "hierarchy"))
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.roots(_nodes(spark, sf_dir))


@query(
    with_views(
        """WITH k AS (SELECT accession AS node, parent, count(*) OVER (PARTITION BY parent) AS n, min(accession) OVER (PARTITION BY parent) AS a FROM hierarchy),
b AS (SELECT parent, min(node) AS b FROM k WHERE node <> a AND parent IS NOT NULL GROUP BY parent)
SELECT node, CASE WHEN k.parent IS NULL THEN 0 ELSE n - 1 END AS n_siblings, CASE WHEN k.parent IS NULL THEN NULL WHEN node = a THEN b ELSE a END AS first FROM k LEFT JOIN b ON k.parent = b.parent""",
        "hierarchy",
    )
)
def tree_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.siblings(_nodes(spark, sf_dir))


@query(
    with_views(
        f"""WITH {ROOTED}, p AS (SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS a, 'C' || CAST(o_custkey % 50 + 1 AS VARCHAR) AS b FROM orders)
SELECT a, b, x.root = y.root AS same FROM p JOIN root x ON x.node = a JOIN root y ON y.node = b""",
        "hierarchy",
    )
)
def same_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pairs = orders.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.lit("C"), (F.col("o_custkey") % 50 + 1).cast("string")).alias("b"))
    return trees.same_family(pairs, _nodes(spark, sf_dir))


@query(
    with_views(
        """WITH h AS (SELECT accession AS node, parent, level <> 'run' AS family, level = 'run' AND substr(accession, 2) LIKE '%7' AS runnable FROM hierarchy),
a AS (SELECT node, parent AS up FROM h WHERE runnable AND parent IS NOT NULL), b AS (SELECT a.node, h.parent AS up FROM a JOIN h ON h.node = a.up WHERE h.parent IS NOT NULL), c AS (SELECT b.node, h.parent AS up FROM b JOIN h ON h.node = b.up WHERE h.parent IS NOT NULL),
n AS (SELECT up, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) t GROUP BY up)
SELECT node, 'childless_family' AS finding FROM h WHERE family AND node NOT IN (SELECT parent FROM h WHERE parent IS NOT NULL)
UNION ALL SELECT node, 'no_runnable_descendant' FROM h LEFT JOIN n ON n.up = h.node WHERE family AND n IS NULL""",
        "hierarchy",
    )
)
def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("level") == "run"
    return trees.tree_findings(_nodes(spark, sf_dir).select("node", "parent", (~run).alias("family"), (run & F.col("node").like("%7")).alias("runnable")))


@query(
    with_views(
        """WITH i AS (SELECT contig % 40 AS contig, start, "end", event_type AS gene FROM spans WHERE start < "end"),
p AS (SELECT DISTINCT contig, x AS start FROM (SELECT contig, start AS x FROM i UNION ALL SELECT contig, "end" FROM i) t),
s AS (SELECT contig, start, lead(start) OVER (PARTITION BY contig ORDER BY start) AS "end" FROM p)
SELECT s.contig, s.start, s."end", string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM s JOIN i ON i.contig = s.contig AND i.start <= s.start AND i."end" >= s."end" WHERE s."end" IS NOT NULL GROUP BY s.contig, s.start, s."end\"""",
        "spans",
    )
)
def active_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "spans").select((F.col("contig") % 40).alias("contig"), "start", "end", F.col("event_type").alias("gene"))
    return intervals.active_sets(rows, 400)


@query(
    with_views(
        """WITH e AS (SELECT contig % 40 AS contig, event_id // 3 AS gene, start, "end" FROM spans WHERE start < "end"),
o AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY contig, gene ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY contig, gene ORDER BY start, "end") AS run FROM o),
m AS (SELECT contig, gene, min(start) AS start, max("end") AS "end" FROM r GROUP BY contig, gene, run),
g AS (SELECT contig, gene, "end" AS start, lead(start) OVER (PARTITION BY contig, gene ORDER BY start) AS "end" FROM m),
s AS (SELECT contig, gene, min(start) AS start, max("end") AS "end" FROM m GROUP BY contig, gene)
SELECT * FROM g WHERE "end" - start >= 20
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.contig = g.contig AND m.start < g."end" AND g.start < m."end")
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.contig = g.contig AND s.gene <> g.gene AND s.start < g."end" AND g.start < s."end")""",
        "spans",
    )
)
def clean_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gene = F.floor(F.col("event_id") / 3)
    rows = view(spark, sf_dir, "spans").select((F.col("contig") % 40).alias("contig"), gene.alias("gene"), "start", "end")
    return intervals.clean_introns(rows, 20, 400)


@query(
    """SELECT 'R' || CAST(o_orderkey AS VARCHAR) AS run_accession, 'https://a/' || CAST(o_orderkey AS VARCHAR) || '_' || CAST(k AS VARCHAR) || '.gz' AS url, md5(CAST(o_orderkey * 10 + k AS VARCHAR)) AS md5, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey + k END AS size
FROM orders, unnest([1, 2]) AS t(k) WHERE o_orderkey % 5 <> 0"""
)
def report_files_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth run has one sum too few, every third no sizes."""
    key, buyer = F.col("o_orderkey"), F.col("o_custkey")
    url = lambda k: F.concat(F.lit("a/"), key.cast("string"), F.lit(f"_{k}.gz"))
    sums = [F.md5((key * 10 + k).cast("string")) for k in (1, 2)]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("R"), key.cast("string")).alias("run_accession"), F.concat_ws(";", url(1), url(2), F.lit("")).alias("fastq_ftp"),
        F.when(key % 5 != 0, F.concat_ws(";", *sums)).otherwise(sums[0]).alias("fastq_md5"), F.when(key % 3 != 0, F.concat_ws(" ; ", (buyer + 1).cast("string"), (buyer + 2).cast("string"))).alias("fastq_bytes"),
    )
    return report_files(rows)
