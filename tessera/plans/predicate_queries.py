"""Queries over signature tests, cells and read sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sequence
from tessera.operators import predicates as ops
from tessera.operators import reads as read_ops
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

CYCLES = """b AS (SELECT file, i - 1 AS cycle, substr(seq, i, 1) AS b FROM reads, unnest(range(1, length(seq) + 1)) AS t(i)),
c AS (SELECT file, cycle, count(*) AS n, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t FROM b GROUP BY file, cycle)"""
MODES = "l AS (SELECT file, length(seq) AS mode, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, length(seq)) AS k FROM reads GROUP BY file, length(seq))"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "reads")


def _verdict(sql: str, value: str, passes: str, score: str, *names: str) -> str:
    return with_views(
        f"{sql} SELECT file, CASE WHEN {value} IS NULL THEN 'abstain' WHEN {passes} THEN 'pass' ELSE 'fail' END AS outcome, round(CASE WHEN {value} IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, {score})) END, 9) AS score, {value} IS NOT NULL AS answerable FROM v",
        *names,
    )


@query(_verdict(f"WITH {MODES}, v AS (SELECT file, mode FROM l WHERE k = 1)", "mode", "mode = 28", "1 - abs(mode - 28) / 2.8", "reads"))
def signature_segment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segment_length(read_ops.read_length_profile(_reads(spark, sf_dir)), 28)


@query(_verdict(f"WITH {MODES}, v AS (SELECT file, mode FROM l WHERE k = 1)", "mode", "mode >= 30 OR abs(mode - 26) <= 1", "CASE WHEN mode >= 30 THEN 1.0 ELSE 1 - abs(mode - 26) / 2.6 END", "reads"))
def signature_over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segment_length(read_ops.read_length_profile(_reads(spark, sf_dir)), 26, 1, 30)


@query(with_views(f"WITH {MODES} SELECT file, mode >= 27 AND mode <= 40 AS compatible FROM l WHERE k = 1", "reads"))
def read_length_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.read_length_compatible(read_ops.read_length_profile(_reads(spark, sf_dir)), 27, 40)


@query(
    _verdict(
        f"""WITH {CYCLES},
m AS (SELECT file, cycle, CASE WHEN a >= c AND a >= g AND a >= t THEN 'A' WHEN c >= g AND c >= t THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END AS b
  FROM (SELECT file, i - 1 AS cycle, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t
    FROM (SELECT file, i, substr(substr(seq, 1, 20), i, 1) AS b FROM reads, unnest(range(1, 21)) AS u(i) WHERE length(seq) >= 20) GROUP BY file, i)),
s AS (SELECT file, string_agg(b, '' ORDER BY cycle) AS s FROM m GROUP BY file),
v AS (SELECT file, avg(CASE WHEN hamming(substr(seq, 1, 20), s) <= 2 THEN 1.0 ELSE 0.0 END) AS rate FROM reads JOIN s USING (file) WHERE length(seq) >= 20 GROUP BY file)""",
        "rate", "rate >= 0.5", "rate / 0.5", "reads",
    )
)
def signature_constant_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.constant_segment(_reads(spark, sf_dir), 0, 20)


@query(_verdict(f"WITH {CYCLES}, v AS (SELECT file, avg(greatest(a, c, g, t) / n) FILTER (cycle >= 6 AND cycle < 18) AS share FROM c GROUP BY file)", "share", "share <= 0.55", "(0.55 - share) / 0.3", "reads"))
def signature_random_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.random_segment(read_ops.per_cycle_composition(_reads(spark, sf_dir)), 6, 18)


@query(_verdict(f"WITH {CYCLES}, v AS (SELECT file, avg(t / n) FILTER (cycle >= 22 AND cycle < 30) AS share FROM c GROUP BY file)", "share", "share >= 0.8", "share", "reads"))
def signature_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.homopolymer_segment(read_ops.per_cycle_composition(_reads(spark, sf_dir)), "T", 22, 30)


@query(_verdict(f"WITH {CYCLES}, v AS (SELECT file, avg(c / n) FILTER (cycle >= 40) AS share FROM c GROUP BY file)", "share", "share >= 0.3", "share / 0.3", "reads"))
def signature_unread_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No read reaches the window: nothing is answered."""
    return ops.base_composition(read_ops.per_cycle_composition(_reads(spark, sf_dir)), "C", 0.3, 40)


@query(_verdict(f"WITH {CYCLES}, v AS (SELECT file, avg(a / n) FILTER (cycle >= 0 AND cycle < 6) AS share FROM c GROUP BY file)", "share", "share >= 0.6", "share / 0.6", "reads"))
def signature_base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.base_composition(read_ops.per_cycle_composition(_reads(spark, sf_dir)), "A", 0.6, 0, 6)


@query(
    with_views(
        """WITH v AS (SELECT file, count(DISTINCT substr(seq, 7, 8)) / count(*) AS ratio FROM reads WHERE length(seq) >= 14 GROUP BY file)
SELECT file, 'abstain' AS outcome, round(1 - ratio, 9) AS score, true AS answerable FROM v""",
        "reads",
    )
)
def signature_distinct_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_test(_reads(spark, sf_dir), 6, 14, "low")


@query(
    _verdict(
        """WITH p AS (SELECT file, substr(seq, 1, 6) AS w FROM reads WHERE length(seq) >= 6),
v AS (SELECT file, avg(CASE WHEN contains(w, 'N') THEN NULL WHEN hamming(w, 'ACGTTT') <= 1 THEN 1.0 ELSE 0.0 END) AS rate FROM p GROUP BY file)""",
        "rate", "rate >= 0.7", "rate / 0.7", "reads",
    )
)
def signature_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.motif_test(read_ops.motif_rate(_reads(spark, sf_dir), "ACGTTT", 0, 1), 0.7)


@query(
    with_views(
        """WITH w AS (SELECT file, substr(seq, 7, 8) AS barcode FROM reads WHERE length(seq) >= 14),
h AS (SELECT file, count(*) AS n, count(onlist.barcode) AS hits FROM w LEFT JOIN onlist USING (barcode) WHERE regexp_matches(w.barcode, '^[ACGT]+$') GROUP BY file),
r AS (SELECT file, hits / n AS rate, (SELECT count(*) FROM onlist) / 65536 AS floor FROM h)
SELECT file, CASE WHEN rate >= 0.9 THEN 'pass' ELSE 'fail' END AS outcome, round(greatest(0.0, least(1.0, (rate - floor) / (0.9 - floor))), 9) AS score, true AS answerable, rate >= greatest(0.05, floor * 50) AS admits FROM r""",
        "reads",
        "onlist",
    )
)
def signature_onlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    onlist = view(spark, sf_dir, "onlist")
    hits = read_ops.onlist_hit_rate(_reads(spark, sf_dir), onlist, 6, 8, 0)
    return ops.onlist_test(hits, onlist.agg(F.count("*").alias("entries")), 8, 0.9)


@query(
    with_views(
        """WITH s AS (SELECT read_id AS file, regexp_replace(name, '^@', '') AS name FROM names),
v AS (SELECT file, CASE WHEN NOT regexp_matches(name, '^[SED]RR\\d+\\.\\d+') THEN len(string_split(name, ':')) >= 7 AND regexp_matches(name, '[ /]([ACGTN]{6,})(\\+[ACGTN]{6,})?\\s*$') END AS has FROM s)
SELECT file, CASE WHEN has IS NULL THEN 'abstain' WHEN has THEN 'pass' ELSE 'fail' END AS outcome, CAST(CASE WHEN has THEN 1 ELSE 0 END AS DOUBLE) AS score, has IS NOT NULL AS answerable FROM v""",
        "names",
    )
)
def signature_header_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read name as that of a file of its own."""
    rows = view(spark, sf_dir, "names").select(F.col("read_id").alias("file"), sequence.read_name(F.col("name")).alias("n"))
    return ops.header_test(rows.select("file", "n.sra_normalized", "n.index"), True)


EVALUATIONS = """SELECT p_brand AS spec, p_type AS role, p_size % 6 AS file, CASE p_partkey % 7 WHEN 0 THEN 'requires' WHEN 1 THEN 'excludes' ELSE 'supports' END AS use,
  CASE WHEN p_partkey % 31 = 0 THEN 'fail' WHEN p_partkey % 29 = 0 THEN 'pass' ELSE 'abstain' END AS outcome, CAST(p_size AS DOUBLE) / 50 AS score, p_partkey % 5 <> 0 AS answerable, CAST(1 + p_partkey % 3 AS DOUBLE) AS weight FROM part"""


@query(
    f"""WITH e AS ({EVALUATIONS}),
g AS (SELECT spec, role, file, count(*) FILTER (use = 'requires' AND outcome = 'fail') AS failed, count(*) FILTER (use = 'excludes' AND outcome = 'pass') AS matched,
  sum(weight * score) FILTER (use = 'supports' AND answerable) AS s, sum(weight) FILTER (use = 'supports' AND answerable) AS w FROM e GROUP BY spec, role, file)
SELECT spec, role, file, failed > 0 OR matched > 0 AS forbidden, CASE WHEN failed > 0 THEN 'requires' WHEN matched > 0 THEN 'excludes' ELSE 'scored' END AS reason,
  CASE WHEN failed > 0 OR matched > 0 THEN 0.0 ELSE round(coalesce(s / w, 0.0), 9) END AS value FROM g"""
)
def scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    use = F.when(key % 7 == 0, "requires").when(key % 7 == 1, "excludes").otherwise("supports")
    outcome = F.when(key % 31 == 0, "fail").when(key % 29 == 0, "pass").otherwise("abstain")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.col("p_brand").alias("spec"), F.col("p_type").alias("role"), (F.col("p_size") % 6).alias("file"), use.alias("use"), outcome.alias("outcome"), (F.col("p_size").cast("double") / 50).alias("score"), (key % 5 != 0).alias("answerable"), (1 + key % 3).cast("double").alias("weight"))
    return ops.score_cells(rows, ["spec", "role", "file"])


@query(
    """WITH e AS (SELECT o_custkey AS dataset, o_orderpriority AS read_set, CASE WHEN bool_or(o_orderkey % 9 = 0) THEN NULL ELSE CAST(max(o_orderkey % 4) AS DOUBLE) END AS value, count(*) AS n_roles FROM orders GROUP BY o_custkey, o_orderpriority),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC NULLS LAST, n_roles DESC, read_set) AS k FROM e)
SELECT dataset, read_set, value, n_roles FROM r WHERE k = 1"""
)
def best_read_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.when(~F.bool_or(F.col("o_orderkey") % 9 == 0), F.max(F.col("o_orderkey") % 4).cast("double"))
    rows = orders.groupBy(F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("read_set")).agg(value.alias("value"), F.count("*").alias("n_roles"))
    return ops.best_read_sets(rows, ["dataset"])
