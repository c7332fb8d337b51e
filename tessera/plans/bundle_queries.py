"""Queries over graded metrics, bundles, deliverables and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import bundles
from tessera.plans.registry import query
from tessera.plans.views import sql_rows, view, with_views

MEASURED = """SELECT s_suppkey AS sample, 'mapped' AS metric, (CAST(s_acctbal AS DOUBLE) + 1000) / 11000 AS value FROM supplier
UNION ALL SELECT s_suppkey, 'reads', CAST(s_acctbal AS DOUBLE) * s_suppkey * 97 FROM supplier UNION ALL SELECT s_suppkey, 'genes', CAST(s_acctbal AS DOUBLE) * 4 FROM supplier
UNION ALL SELECT s_suppkey, 'depth', CAST(s_suppkey AS DOUBLE) / 20 FROM supplier UNION ALL SELECT s_suppkey, 'unbarred', CAST(s_suppkey AS DOUBLE) FROM supplier
UNION ALL SELECT s_suppkey, 'mapped', CAST(NULL AS DOUBLE) FROM supplier WHERE s_suppkey % 10 = 0"""
BARS = """SELECT 'mapped' AS metric, 'fraction' AS kind, CAST(0.7 AS DOUBLE) AS ok, CAST(0.4 AS DOUBLE) AS warn, true AS higher
UNION ALL SELECT 'reads', 'count', CAST(1000000 AS DOUBLE), CAST(10000 AS DOUBLE), true UNION ALL SELECT 'genes', 'exact', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), true
UNION ALL SELECT 'depth', 'ratio', CAST(2 AS DOUBLE), CAST(4 AS DOUBLE), false"""


@query(
    f"""WITH m AS ({MEASURED}), b AS ({BARS}), j AS (SELECT *, CASE WHEN value < 0 AND round_even(value, 0) = 0 THEN '-0' ELSE format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) END AS whole FROM m JOIN b USING (metric) WHERE value IS NOT NULL)
SELECT sample, metric, value, CASE kind WHEN 'fraction' THEN printf('%.1f', value * 100) || '%' WHEN 'exact' THEN whole WHEN 'ratio' THEN printf('%.1f', value)
  ELSE CASE WHEN abs(value) >= 1e9 THEN printf('%.1f', value / 1e9) || 'B' WHEN abs(value) >= 1e6 THEN printf('%.1f', value / 1e6) || 'M' WHEN abs(value) >= 1e3 THEN printf('%.1f', value / 1e3) || 'K' ELSE whole END END AS display,
  CASE WHEN ok IS NULL OR warn IS NULL THEN 'none' WHEN (higher AND value >= ok) OR (NOT higher AND value <= ok) THEN 'ok' WHEN (higher AND value >= warn) OR (NOT higher AND value <= warn) THEN 'warn' ELSE 'bad' END AS level FROM j"""
)
def graded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.graded_metrics(sql_rows(spark, sf_dir, MEASURED, "supplier"), spark.sql(BARS))


PARTS = """SELECT s_suppkey AS sample, 1 AS part, CAST(NULL AS VARCHAR) AS component, 'balance' AS metric, CAST(s_acctbal AS DOUBLE) AS value FROM supplier
UNION ALL SELECT l_suppkey, 2, l_returnflag, 'lines', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_suppkey, l_returnflag
UNION ALL SELECT l_suppkey, 2, l_returnflag, 'first', CAST(min(l_orderkey) AS DOUBLE) FROM lineitem GROUP BY l_suppkey, l_returnflag"""


@query(
    f"""WITH m AS (SELECT sample, part, metric || coalesce('_' || component, '') AS metric, value FROM ({PARTS}) t)
SELECT sample, CAST(row_number() OVER (PARTITION BY sample ORDER BY part, metric) - 1 AS INTEGER) AS ordinal, metric, value FROM m"""
)
def sample_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.sample_bundles(sql_rows(spark, sf_dir, PARTS, "supplier", "lineitem"))


TRIALS = """SELECT l_orderkey AS "case", CASE l_partkey % 8 WHEN 0 THEN 'false_accept' WHEN 1 THEN 'false_refuse' WHEN 2 THEN 'mis_triage' WHEN 3 THEN 'wrong_reason' WHEN 4 THEN 'over_ask' WHEN 5 THEN 'unheard' ELSE 'correct' END AS outcome FROM lineitem"""


@query(
    f"""WITH t AS ({TRIALS}), o AS (SELECT ['false_accept', 'false_refuse', 'mis_triage', 'wrong_reason', 'over_ask', 'correct'] AS l)
SELECT "case", count(*) AS n_trials, any_value(l)[min(nullif(list_position(l, outcome), 0))] AS outcome FROM t, o GROUP BY "case\""""
)
def worst_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.worst_outcomes(sql_rows(spark, sf_dir, TRIALS, "lineitem"))


DEMANDED = "SELECT n_nationkey AS dataset, 'counts/{component}.h5' AS pattern FROM nation UNION ALL SELECT n_nationkey, 'qc.json' FROM nation"
COMPONENTS = "SELECT c_nationkey AS dataset, c_mktsegment AS component FROM customer WHERE c_nationkey % 5 <> 0"
PRESENT = "SELECT DISTINCT c_nationkey AS dataset, 'counts/' || c_mktsegment || '.h5' AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT n_nationkey, 'qc.json' FROM nation WHERE n_nationkey % 2 = 0"


@query(
    f"""WITH d AS ({DEMANDED}), c AS (SELECT DISTINCT * FROM ({COMPONENTS}) t), p AS ({PRESENT})
SELECT dataset, coalesce(replace(pattern, '{{component}}', component), pattern) AS name FROM d LEFT JOIN c USING (dataset) WHERE contains(pattern, 'component') EXCEPT SELECT dataset, name FROM p
UNION ALL (SELECT dataset, pattern FROM d WHERE NOT contains(pattern, 'component') EXCEPT SELECT dataset, name FROM p)"""
)
def missing_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.missing_deliverables(sql_rows(spark, sf_dir, DEMANDED, "nation"), sql_rows(spark, sf_dir, COMPONENTS, "customer"), sql_rows(spark, sf_dir, PRESENT, "customer", "nation"))


ASSEMBLIES = "SELECT p_name || '/' || CAST(p_partkey % 300 AS VARCHAR) AS assembly, p_size AS component FROM part"
CAPS = "SELECT DISTINCT p_size AS component, p_size * 1000 AS cap FROM part WHERE p_size % 10 <> 0"


@query(f"WITH a AS ({ASSEMBLIES}), c AS ({CAPS}) SELECT assembly, CASE WHEN count(*) = count(cap) THEN max(cap) END AS cap FROM a LEFT JOIN c USING (component) GROUP BY assembly")
def loosest_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.loosest_caps(sql_rows(spark, sf_dir, ASSEMBLIES, "part"), sql_rows(spark, sf_dir, CAPS, "part"))


OWN = "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS accession, 'segment' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'name', n_name FROM nation"
BETTER = "SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS accession, 'country' AS name, lower(n_name) AS value FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'band', 'x' FROM customer WHERE c_custkey % 2 = 0"


@query(
    with_views(
        f"""WITH o AS ({OWN}), b AS ({BETTER}), t AS (SELECT accession FROM hierarchy WHERE level = 'sample' AND accession IN (SELECT accession FROM b))
SELECT * FROM o WHERE accession NOT IN (SELECT accession FROM t) AND accession IN (SELECT accession FROM hierarchy) UNION ALL SELECT * FROM b WHERE accession IN (SELECT accession FROM t)""",
        "hierarchy",
    )
)
def preferred_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.preferred_attributes(view(spark, sf_dir, "hierarchy"), sql_rows(spark, sf_dir, OWN, "customer", "nation"), sql_rows(spark, sf_dir, BETTER, "customer", "nation"))


COUNTED = "SELECT o_orderkey AS run, o_custkey % 5 AS read_count, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 300 END AS base_count FROM orders"
STATISTICS = "SELECT o_orderkey AS run, CAST(50 + o_orderkey % 37 AS DOUBLE) AS spot_length FROM orders"


@query(
    f"""WITH c AS ({COUNTED}), s AS ({STATISTICS}) SELECT run, spot_length, round(base_count / read_count, 2) AS published, round(spot_length - base_count / read_count, 2) AS missing
FROM c JOIN s USING (run) WHERE read_count > 0 AND base_count > 0 AND spot_length > base_count / read_count + 1"""
)
def dropped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.dropped_reads(sql_rows(spark, sf_dir, COUNTED, "orders"), sql_rows(spark, sf_dir, STATISTICS, "orders"))


PAPERS = """SELECT o_orderkey AS doc, CASE o_orderkey % 4 WHEN 0 THEN 'no accession, xGSE12 and GSE' WHEN 1 THEN 'see GSE' || CAST(o_custkey AS VARCHAR) || '.' WHEN 2 THEN 'GSE' || CAST(o_custkey AS VARCHAR) || ' (PRJNA' || CAST(o_orderkey % 50 AS VARCHAR) || ')' END AS text FROM orders"""
STUDIES = "SELECT 'GSE' || CAST(c_custkey AS VARCHAR) AS accession FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'PRJNA' || CAST(n_nationkey AS VARCHAR) FROM nation"


@query(
    rf"""WITH d AS ({PAPERS}), o AS ({STUDIES}), n AS (SELECT DISTINCT doc, unnest(regexp_extract_all(text, '\b(?:GSE\d+|PRJ[A-Z][A-Z]\d+)\b')) AS accession FROM d),
h AS (SELECT doc, bool_or(accession IN (SELECT accession FROM o)) AS ours FROM n GROUP BY doc)
SELECT doc, CASE WHEN ours IS NULL THEN 'abstain' WHEN ours THEN 'match' ELSE 'mismatch' END AS signal FROM d LEFT JOIN h USING (doc)"""
)
def study_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.study_signals(sql_rows(spark, sf_dir, PAPERS, "orders"), sql_rows(spark, sf_dir, STUDIES, "customer", "nation"))


ASSERTED = "SELECT p_partkey AS dataset, CASE p_partkey % 5 WHEN 0 THEN 'wild type' WHEN 1 THEN CAST(NULL AS VARCHAR) ELSE 'the ' || p_name || ' line' END AS value FROM part"
RECORDED = "SELECT p_partkey AS dataset, upper(p_type) || '; ' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE 'control' END AS value FROM part WHERE p_partkey % 7 <> 0"


@query(
    f"""WITH a AS ({ASSERTED}), r AS ({RECORDED}),
x AS (SELECT dataset, 1 AS side, unnest(regexp_split_to_array(lower(value), '[^a-z0-9]+')) AS w FROM a UNION ALL SELECT dataset, 2, unnest(regexp_split_to_array(lower(value), '[^a-z0-9]+')) FROM r),
s AS (SELECT DISTINCT * FROM x WHERE length(w) >= 2 AND w NOT IN ('wild', 'type', 'wildtype', 'strain', 'control', 'mutant', 'line', 'the', 'and')),
n AS (SELECT dataset, count(DISTINCT side) AS sides FROM s GROUP BY dataset), h AS (SELECT DISTINCT dataset FROM (SELECT dataset FROM s GROUP BY dataset, w HAVING count(*) = 2) t)
SELECT d.dataset, CASE WHEN sides IS NULL OR sides < 2 THEN 'abstain' WHEN h.dataset IS NOT NULL THEN 'match' ELSE 'mismatch' END AS signal
FROM (SELECT dataset FROM a UNION SELECT dataset FROM r) d LEFT JOIN n ON n.dataset = d.dataset LEFT JOIN h ON h.dataset = d.dataset"""
)
def strain_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.strain_signals(sql_rows(spark, sf_dir, ASSERTED, "part"), sql_rows(spark, sf_dir, RECORDED, "part"))


LINES = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '  ' || p_brand || '   ' || CAST(p_size AS VARCHAR) || '.5 ' WHEN 1 THEN p_brand WHEN 2 THEN 'n  ' || CAST(p_size AS VARCHAR) ELSE p_type || '  1   2' END AS line FROM part"


@query(
    rf"""WITH l AS ({LINES}), w AS (SELECT id, list_filter(regexp_split_to_array(line, ' +'), lambda x: x <> '') AS w FROM l)
SELECT id, w[1] AS name, array_to_string(w[2:], ' ') AS value, CASE WHEN len(w) > 2 THEN 'str' WHEN regexp_full_match(w[2], '\d+') THEN 'int' WHEN regexp_full_match(w[2], '\d+\.\d+') THEN 'float' ELSE 'str' END AS kind FROM w WHERE len(w) >= 2"""
)
def name_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.name_value_lines(sql_rows(spark, sf_dir, LINES, "part"))
