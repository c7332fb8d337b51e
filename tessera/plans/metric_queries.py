"""Queries over per-sample metrics, rankings and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as ops
from tessera.plans.registry import query
from tessera.plans.views import view, with_views


@query(
    """WITH v AS (SELECT o_custkey, count(*) AS value FROM orders GROUP BY o_custkey),
r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS rank, count(*) OVER () AS n FROM v),
w AS (SELECT DISTINCT least(n, greatest(1, CAST(round(exp(ln(n) * k / 199)) AS BIGINT))) AS rank FROM (SELECT max(n) AS n FROM r) m, unnest(range(200)) AS u(k))
SELECT rank, value FROM r WHERE n <= 200 OR rank IN (SELECT rank FROM w)"""
)
def knee_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.knee_points(spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("value")))


@query(
    """WITH v AS (SELECT s_suppkey, count(*) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_suppkey)
SELECT row_number() OVER (ORDER BY s_suppkey DESC) AS rank, s_suppkey AS value FROM (SELECT s_suppkey FROM v ORDER BY s_suppkey DESC LIMIT 100) t"""
)
def short_knee_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 largest keys: below 200 values every rank is a point."""
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("value"))
    return ops.knee_points(keys.orderBy(F.desc("value")).limit(100))


@query(
    with_views(
        """WITH r AS (SELECT sample, run, CASE WHEN count(*) = count(reads) THEN min(reads) END AS reads FROM depths GROUP BY sample, run),
s AS (SELECT sample, CAST(CASE WHEN count(*) = count(reads) THEN sum(reads) END AS BIGINT) AS reads FROM r GROUP BY sample)
SELECT sample, reads, CASE WHEN reads IS NULL THEN 'unmeasured' WHEN reads >= 150 THEN 'admitted' ELSE 'starved' END AS verdict FROM s""",
        "depths",
    )
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.admission(view(spark, sf_dir, "depths"), 150)


@query(
    """WITH t AS (SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_custkey % 6 <> 0 GROUP BY o_custkey),
o AS (SELECT o_custkey AS key, count(*) + o_custkey % 3 - 1 AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey),
b AS (SELECT t.n AS t, o.n AS o FROM t FULL JOIN o ON t.key = o.key)
SELECT count(*) FILTER (t = o) AS exact, count(*) FILTER (o > t) AS inflated, count(*) FILTER (o < t) AS deflated, count(*) FILTER (o IS NULL) AS missed, count(*) FILTER (t IS NULL) AS spurious,
  CAST(sum(least(t, o)) FILTER (t IS NOT NULL AND o IS NOT NULL) AS BIGINT) AS recovered, CAST(sum(t) AS BIGINT) AS truth FROM b"""
)
def compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    return ops.compare_counts(by.where("key % 6 <> 0"), by.where("key % 5 <> 0").select("key", (F.col("n") + F.col("key") % 3 - 1).alias("n")))


@query(
    """SELECT l_suppkey, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(l_quantity) > 0 THEN round(regr_slope(l_partkey % 100, l_quantity), 6) END AS slope,
  CASE WHEN count(*) >= 3 AND var_pop(l_quantity) > 0 THEN round(regr_intercept(l_partkey % 100, l_quantity), 6) END AS intercept FROM lineitem GROUP BY l_suppkey"""
)
def fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fits = ops.fit_line(rows.select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y")), ["l_suppkey"])
    return fits.select("l_suppkey", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    """WITH f AS (SELECT s_suppkey, 'low_balance' AS alert FROM supplier WHERE s_acctbal < 1000 UNION ALL SELECT s_suppkey, 'named' FROM supplier UNION ALL SELECT s_suppkey, 'far' FROM supplier WHERE s_nationkey > 20)
SELECT alert, count(DISTINCT s_suppkey) AS n_samples, string_agg(DISTINCT CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS samples, count(DISTINCT s_suppkey) = (SELECT count(*) FROM supplier) AND (SELECT count(*) FROM supplier) > 1 AS systematic FROM f GROUP BY alert"""
)
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    fire = lambda name, when: rows.where(when).select(F.lit(name).alias("alert"), F.col("s_suppkey").alias("sample"))
    found = fire("low_balance", "s_acctbal < 1000").union(fire("named", "true")).union(fire("far", "s_nationkey > 20"))
    return ops.alerts(found, rows.select(F.col("s_suppkey").alias("sample")))


TIE = """r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, rung DESC, name) AS place, round(max(value) OVER (PARTITION BY dataset) - value, 9) <= 0.02 AS in_tie FROM candidates)"""


@query(with_views(f"WITH {TIE} SELECT dataset, name, CAST(place AS INTEGER) AS place, in_tie FROM r", "candidates"))
def tie_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tie_band(view(spark, sf_dir, "candidates"), ["dataset"]).select("dataset", "name", "place", "in_tie")


@query(
    with_views(
        f"""WITH {TIE},
g AS (SELECT dataset, CASE WHEN count(*) = 1 THEN arg_min(name, place) WHEN count(*) FILTER (hit) = 1 THEN min(CASE WHEN hit THEN name END) END AS winner, string_agg(DISTINCT name, ',' ORDER BY name) AS options FROM r WHERE in_tie GROUP BY dataset)
SELECT dataset, winner, CASE WHEN winner IS NULL THEN options END AS question FROM g""",
        "candidates",
    )
)
def escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.escalated(view(spark, sf_dir, "candidates"), ["dataset"])


@query(
    """WITH t AS (SELECT p_brand, p_type, CAST(p_size AS DOUBLE) / 50 AS score, CAST(1 + p_partkey % 3 AS DOUBLE) AS weight, p_partkey % 4 <> 0 AS answerable, p_partkey % 97 = 0 AS gate_failed FROM part)
SELECT p_brand, p_type, bool_or(gate_failed) AS forbidden, CASE WHEN NOT bool_or(gate_failed) THEN round(coalesce(sum(CASE WHEN answerable THEN weight * score END) / sum(CASE WHEN answerable THEN weight END), 0.0), 6) END AS value FROM t GROUP BY p_brand, p_type"""
)
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    tests = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_type", (F.col("p_size").cast("double") / 50).alias("score"), (1 + key % 3).cast("double").alias("weight"), (key % 4 != 0).alias("answerable"), (key % 97 == 0).alias("gate_failed"))
    return ops.weighted_score(tests, ["p_brand", "p_type"])


@query("SELECT o_orderkey, o_custkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 3 AS BIGINT) AS chunk FROM orders")
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    return ops.chunked(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey", "chunk")


@query(
    """WITH RECURSIVE r AS (SELECT conv_id AS key, turn AS ordinal, md5(text) AS sha, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
w AS (SELECT key, ordinal, i, CAST(0 AS BIGINT) AS batch, 1 AS size, chars, [sha] AS seen FROM r WHERE i = 1
  UNION ALL SELECT key, ordinal, i, batch + shut, CASE WHEN shut = 1 THEN 1 ELSE size + 1 END, CASE WHEN shut = 1 THEN new ELSE chars + new END, CASE WHEN shut = 1 THEN [sha] ELSE list_append(seen, sha) END
  FROM (SELECT r.key, r.ordinal, r.i, r.sha, r.chars AS new, w.batch, w.size, w.chars, w.seen, CASE WHEN w.size >= 4 OR w.chars + r.chars > 2000 OR list_contains(w.seen, r.sha) THEN 1 ELSE 0 END AS shut FROM w JOIN r ON r.key = w.key AND r.i = w.i + 1) n)
SELECT key, ordinal, batch FROM w"""
)
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return ops.greedy_batches(rows.select(F.col("conv_id").alias("key"), F.col("turn").alias("ordinal"), F.md5("text").alias("sha"), F.length("text").alias("chars")), 4, 2000)


@query(
    with_views(
        "SELECT subject AS sample, min(value) FILTER (attribute = 'segment') AS segment, min(value) FILTER (attribute = 'band') AS band, min(value) FILTER (attribute = 'nation') AS nation FROM claims GROUP BY subject",
        "claims",
    )
)
def attribute_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.attribute_table(view(spark, sf_dir, "claims").withColumnRenamed("subject", "sample"), ["segment"])
