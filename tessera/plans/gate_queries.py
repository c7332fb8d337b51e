"""Queries over spans, pairs and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import gates, spans, variants
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

#: The quote q as a pattern in which any white space fits white space.
PATTERN = r"""regexp_replace(regexp_replace(trim(regexp_replace(q, '[ \t\n\r\f\v]+', ' ', 'g')), '([\\.\[\]{}()*+?^$|])', '\\\1', 'g'), ' ', '\\s+', 'g')"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    with_views(
        rf"""WITH e AS (SELECT doc_id, text, q, trim(regexp_replace(q, '[ \t\n\r\f\v]+', ' ', 'g')) AS tight, {PATTERN} AS p FROM quoted),
h AS (SELECT *, CASE WHEN tight = '' THEN NULL WHEN contains(text, q) THEN 'exact' WHEN contains(text, tight) THEN 'squashed' WHEN regexp_matches(text, p) THEN 'flexible' END AS how FROM e),
s AS (SELECT *, CASE how WHEN 'exact' THEN strpos(text, q) - 1 WHEN 'squashed' THEN strpos(text, tight) - 1 WHEN 'flexible' THEN length(regexp_extract(text, '(?s)^(.*?)(' || p || ')', 1)) END AS start FROM h)
SELECT doc_id, CAST(start AS INT) AS start, CAST(start + CASE how WHEN 'exact' THEN length(q) WHEN 'squashed' THEN length(tight) ELSE length(regexp_extract(text, '(?s)^(.*?)(' || p || ')', 2)) END AS INT) AS "end", how FROM s""",
        "quoted",
    )
)
def quote_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "quoted").select("doc_id", spans.find_span(F.col("text"), F.col("q")).alias("s"))
    return rows.select("doc_id", "s.*")


@query(
    with_views(
        r"""WITH x AS (SELECT d.*, a.text, CASE WHEN contains(a.text, quote) THEN instr(a.text, quote) - 1 WHEN contains(a.text, replace(quote, '  ', ' ')) THEN instr(a.text, replace(quote, '  ', ' ')) - 1 END AS start,
  length(CASE WHEN contains(a.text, quote) THEN quote ELSE replace(quote, '  ', ' ') END) AS n, instr(a.text, segment) - 1 AS k FROM drafts d LEFT JOIN cards a ON a.id = d.doc)
SELECT draft, CASE WHEN field = 'secret' THEN 'field_not_permitted' WHEN text IS NOT NULL AND field = 'steer' THEN 'field_not_permitted_for_doc' WHEN text IS NULL THEN 'unknown_document' WHEN start IS NULL THEN 'span_not_found'
    WHEN start >= k AND start + n <= k + length(segment) THEN 'quote_is_a_typed_column' WHEN NOT (contains(lower(quote), lower(value)) OR field = 'kind' AND value = 'MAKER' AND contains(quote, 'BUILDING')) THEN 'not_entailed'
    WHEN field = 'kind' AND value NOT IN ('BUILDING', 'MACHINERY', 'MAKER') THEN 'not_in_vocabulary' ELSE 'verified' END AS reason,
  CAST(start AS INT) AS start, CAST(start + n AS INT) AS "end", CASE WHEN start >= k AND start + n <= k + length(segment) THEN 'segment' END AS "column" FROM x""",
        "drafts",
        "cards",
    )
)
def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafted claims on customers' cards, each of which types its market segment into a column of its own."""
    cards, drafts = view(spark, sf_dir, "cards"), view(spark, sf_dir, "drafts")
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("segment").alias("attribute"), F.col("c_mktsegment").alias("value"))
    documents = cards.select(F.col("id").alias("doc"), F.lit("reference").alias("role"), F.lit("sample").alias("scope"), "text")
    permitted = spark.createDataFrame([("reference", "sample", "kind"), ("reference", "sample", "topic"), ("instruction", "dataset", "steer")], "role string, scope string, field string")
    forms = spark.createDataFrame([("kind", "MAKER", "BUILDING")], "field string, value string, form string")
    vocabulary = spark.createDataFrame([("kind", w) for w in ("BUILDING", "MACHINERY", "MAKER")], "field string, form string")
    return spans.verified_claims(drafts.drop("segment"), documents, permitted, declared=variants.declared_spans(cards, customer), forms=forms, vocabulary=vocabulary)


@query(
    """WITH o AS (SELECT conv_id AS doc, turn AS page, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS e, length(text) AS n FROM conversations),
p AS (SELECT doc, page, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM o),
s AS (SELECT DISTINCT conv_id AS span, conv_id AS doc, conv_id * 31 % 400 AS pos FROM conversations)
SELECT span, CASE WHEN pos < e THEN page END AS page FROM (SELECT span, pos, arg_max(page, start) AS page, arg_max("end", start) AS e FROM s LEFT JOIN p ON p.doc = s.doc AND start <= pos GROUP BY span, pos)"""
)
def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    offsets = spans.page_offsets(rows.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))
    return spans.page_of(rows.select(F.col("conv_id").alias("span"), F.col("conv_id").alias("doc"), (F.col("conv_id") * 31 % 400).alias("at")).distinct(), offsets)


@query("SELECT conv_id AS key, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def joined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("part"), "text")
    return spans.joined_documents(rows).select("key", F.md5("text").alias("digest"))


@query(
    """WITH a AS (SELECT o_custkey AS run, o_orderpriority AS lane, o_orderkey AS path FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS run, o_orderpriority AS lane, o_orderkey AS path FROM orders WHERE o_orderkey % 2 = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY run, lane ORDER BY path) AS place FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY run, lane ORDER BY path) AS place FROM b)
SELECT run, lane, CAST(place AS INTEGER) AS place, x.path AS path_1, y.path AS path_2, bool_or(x.path IS NULL OR y.path IS NULL) OVER (PARTITION BY run, lane) AS refused FROM x FULL JOIN y USING (run, lane, place)"""
)
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("lane"), F.col("o_orderkey").alias("path"))
    return gates.paired(files.where("path % 2 = 0"), files.where("path % 2 = 1"), ["run", "lane"])


@query(
    """WITH r AS (SELECT l_orderkey AS template, CASE WHEN l_orderkey % 9 = 0 THEN CAST(l_linenumber % 2 AS VARCHAR) ELSE CAST(l_orderkey % 3 AS VARCHAR) END AS part FROM lineitem)
SELECT template, CASE WHEN min(part) = max(part) THEN min(part) END AS component, min(part) <> max(part) AS spanning, count(*) AS records FROM r GROUP BY template"""
)
def routed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("l_orderkey") % 9 == 0, F.col("l_linenumber") % 2).otherwise(F.col("l_orderkey") % 3).cast("string")
    return gates.routed(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("template"), F.concat(F.lit("chr_x_"), part).alias("reference")))


@query(
    """SELECT 'order_customer' AS "check", CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) GROUP BY o_custkey
UNION ALL SELECT 'customer_nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY c_nationkey"""
)
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    one = gates.broken_references(_table(spark, sf_dir, "orders"), "o_custkey", customer.where("c_custkey % 50 <> 0"), "c_custkey", "order_customer")
    return one.union(gates.broken_references(customer, "c_nationkey", _table(spark, sf_dir, "nation").where("n_regionkey <> 2"), "n_nationkey", "customer_nation"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'integrity' WHEN s_nationkey > 20 THEN 'no_candidate' WHEN s_suppkey % 6 = 0 THEN 'tie' ELSE 'passed' END AS gate FROM supplier")
def gate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.first_gate(_table(spark, sf_dir, "supplier"), "s_suppkey", [("integrity", "s_acctbal < 0"), ("no_candidate", "s_nationkey > 20"), ("tie", "s_suppkey % 6 = 0"), ("never", "cast(null as boolean)")])


@query(
    """WITH r AS (SELECT o_custkey AS sample, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'fixed' END AS w FROM orders)
SELECT sample, count(*) AS n_runs, CASE WHEN min(w) = max(w) THEN min(w) END AS winner, CASE WHEN count(w) = 0 THEN 'unresolved' WHEN min(w) <> max(w) THEN 'disagreed' WHEN count(w) < count(*) THEN 'inherited' ELSE 'agreed' END AS outcome FROM r GROUP BY sample"""
)
def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    winner = F.when(F.col("o_orderkey") % 4 != 0, F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise("fixed"))
    return gates.run_agreement(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("run"), winner.alias("winner")))


@query(
    """WITH g AS (SELECT o_custkey AS customer, o_orderpriority AS reason, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY n DESC, seen) AS k, sum(n) OVER (PARTITION BY customer) AS t FROM g)
SELECT customer, reason, CAST(t AS BIGINT) AS n FROM k WHERE k = 1"""
)
def common_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("ordinal"))
    return gates.common_reason(rows, ["customer"])


@query(
    """WITH e AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'decide' WHEN 1 THEN 'ask' ELSE 'refuse' END AS o, p_brand AS v, CASE p_partkey % 5 WHEN 0 THEN 'decide' WHEN 1 THEN 'ask' WHEN 2 THEN 'refuse' ELSE CASE p_partkey % 3 WHEN 0 THEN 'decide' WHEN 1 THEN 'ask' ELSE 'refuse' END END AS g, CASE WHEN p_partkey % 8 = 0 THEN 'x' ELSE p_brand END AS gv FROM part)
SELECT k AS "case", CASE WHEN k % 10 = 9 THEN 'not_run' WHEN o = g AND (o <> 'decide' OR v = gv) THEN 'correct' WHEN o = g THEN 'wrong_value' WHEN g = 'decide' THEN 'wrong_decision' WHEN o = 'decide' THEN 'over_cautious' ELSE 'wrong_outcome' END AS grade FROM e"""
)
def graded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    three = F.when(k % 3 == 0, "decide").when(k % 3 == 1, "ask").otherwise("refuse")
    expected = part.select(k.alias("case"), three.alias("outcome"), F.col("p_brand").alias("value"))
    five = F.when(k % 5 == 0, "decide").when(k % 5 == 1, "ask").when(k % 5 == 2, "refuse").otherwise(three)
    actual = part.where(k % 10 != 9).select(k.alias("case"), five.alias("outcome"), F.when(k % 8 == 0, "x").otherwise(F.col("p_brand")).alias("value"))
    return gates.graded_cases(expected, actual)


@query("SELECT s_suppkey, metric, value FROM (SELECT s_suppkey, 'balance' AS metric, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier) t WHERE value IS NOT NULL")
def unpivoted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return gates.unpivoted(rows, "s_suppkey", ["balance", "nation"])


@query(
    """WITH v AS (SELECT o_custkey, CAST(round(sum(o_totalprice)) AS BIGINT) * 1000 AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n >= 1000000000 THEN printf('%.1fB', n / 1000000000) WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.1fK', n / 1000) ELSE CAST(n AS VARCHAR) END AS short FROM v"""
)
def short_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.round(F.sum("o_totalprice"), 0).cast("long") * 1000).alias("n"))
    return by.select("o_custkey", fn.short_count(F.col("n")).alias("short"))


@query("""SELECT event_id, k.key AS key, CAST(json_extract_string(props, '$."' || k.key || '"') AS VARCHAR) AS value FROM events, unnest(json_keys(props)) AS k(key)""")
def flattened_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("key", "value"))
