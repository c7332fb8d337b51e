"""Queries over texts, names and loosely typed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize, text as fn
from tessera.operators import spans
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

STOP = ["the", "of", "and", "a"]


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(replace(lower(text), '-', ' '), '[a-z0-9'']+')) AS INTEGER) AS n_tokens, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS n_values,
  CAST(length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS INTEGER) AS n_squashed, CAST(length(text) // 4 AS BIGINT) AS estimated FROM documents"""
)
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("text")
    return docs.select("doc_id", F.size(fn.tokens(text)).alias("n_tokens"), F.size(fn.token_values(text)).alias("n_values"), F.length(fn.squash(text)).alias("n_squashed"), F.floor(F.length(text) / 4).alias("estimated"))


@query(
    """WITH c AS (SELECT doc_id, substr(replace(text, ' ', ''), i, 1) AS ch, count(*) AS n FROM documents, unnest(range(1, length(replace(text, ' ', '')) + 1)) AS u(i) GROUP BY doc_id, ch),
t AS (SELECT doc_id, sum(n) AS s FROM c GROUP BY doc_id)
SELECT doc_id, round(-sum(n / s * log2(n / s)), 6) AS bits, bool_and(s >= 400) AND round(-sum(n / s * log2(n / s)), 6) < 2.5 AS refused FROM c JOIN t USING (doc_id) GROUP BY doc_id"""
)
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chars = docs.select("doc_id", F.explode(F.split(F.replace("text", F.lit(" "), F.lit("")), "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    total = chars.groupBy("doc_id").agg(F.sum("n").alias("s"))
    share = F.col("n") / F.col("s")
    by = chars.join(total, "doc_id").groupBy("doc_id").agg(F.round(-F.sum(share * F.log2(share)), 6).alias("bits"), F.max("s").alias("s"))
    return by.select("doc_id", "bits", ((F.col("s") >= 400) & (F.col("bits") < 2.5)).alias("refused"))


@query(
    r"""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || '%' WHEN 2 THEN ' ' || CAST(p_size AS VARCHAR) || '.5 ' ELSE CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) || '_000' ELSE CASE WHEN p_size % 2 = 0 THEN '-Inf' ELSE 'nan' END END END AS v FROM part)
SELECT p_partkey, CASE WHEN lower(trim(v)) IN ('-inf', 'nan') THEN 'float' WHEN regexp_matches(trim(v), '^[+-]?\d+(_\d+)*$') THEN 'int' WHEN regexp_matches(trim(v), '^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$') THEN 'float' ELSE 'str' END AS kind,
  CASE WHEN suffix(trim(v), '%') THEN try_cast(rtrim(trim(v), '%') AS DOUBLE) / 100 WHEN lower(trim(v)) IN ('-inf', 'nan') OR contains(v, '_') THEN NULL ELSE try_cast(trim(v) AS DOUBLE) END AS number FROM v"""
)
def value_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size, place = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("_000"))).when(F.col("p_size") % 2 == 0, "-Inf").otherwise("nan")
    value = F.when(place == 0, size).when(place == 1, F.concat(size, F.lit("%"))).when(place == 2, F.concat(F.lit(" "), size, F.lit(".5 "))).otherwise(other)
    return part.select("p_partkey", fn.value_kind(value).alias("kind"), F.when(~F.lower(F.trim(value)).isin("-inf", "nan"), fn.as_number(value)).alias("number"))


@query(
    """WITH f AS (SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE 'the ' || p_brand || ' of ' || p_name END AS form FROM part),
t AS (SELECT *, p_name || ' and ' || p_brand || ' - ' || p_type AS text FROM f),
k AS (SELECT *, list_filter(regexp_extract_all(replace(lower(form), '-', ' '), '[a-z0-9'']+'), lambda x: x NOT IN ('the', 'of', 'and', 'a')) AS w, regexp_extract_all(replace(lower(text), '-', ' '), '[a-z0-9'']+') AS h FROM t)
SELECT p_partkey, contains(lower(text), lower(form)) OR (len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(h, x))) = 0) AS carried FROM k"""
)
def carried_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    form = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit("the "), "p_brand", F.lit(" of "), "p_name"))
    text = F.concat("p_name", F.lit(" and "), "p_brand", F.lit(" - "), "p_type")
    return part.select("p_partkey", fn.carries(text, form, STOP).alias("carried"))


@query(
    with_views(
        """WITH x AS (SELECT id, name, regexp_replace(regexp_replace(name, '\\.(fastq|fq)(\\.gz)?$', ''), '_(?:[RI][12]|[1-4])(_001)?$', '') AS stem, regexp_replace(name, '\\.([Ff][Aa][Ss][Tt][Qq]|[Ff][Qq])(\\.[Gg][Zz])?$', '') AS whole FROM file_names)
SELECT id, CASE WHEN regexp_matches(name, '^[SED]RR\\d+') THEN regexp_extract(name, '^([SED]RR\\d+)', 1) ELSE regexp_replace(stem, '_L\\d{3}$', '') END AS run, regexp_extract(name, '_(L\\d{3})(?:_|\\.)', 1) AS lane,
  coalesce(nullif(upper(regexp_extract(whole, '[._]([RIri][1-4])([._]\\d{3})?$', 1)), ''), nullif(regexp_extract(whole, '[._]([Rr][Ee][Aa][Dd][-_]?)?([1-4])([._]\\d{3})?$', 2), '')) AS mate,
  CASE WHEN regexp_matches(split_part(name, '_', 1), '^[SED]RR\\d+$') THEN 'run' END AS kind FROM x""",
        "file_names",
    )
)
def file_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    rows = view(spark, sf_dir, "file_names")
    return rows.select("id", fn.run_key(name).alias("run"), fn.lane_of(name).alias("lane"), fn.read_designation(name).alias("mate"), fn.accession_kind(F.split(name, "_")[0]).alias("kind"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'none' WHEN s_acctbal >= 5000 THEN 'ok' WHEN s_acctbal >= 1000 THEN 'warn' ELSE 'bad' END AS balance,
  CASE WHEN s_nationkey <= 5 THEN 'ok' WHEN s_nationkey <= 15 THEN 'warn' ELSE 'bad' END AS nation, sha256('supplier' || chr(10) || CAST(s_suppkey AS VARCHAR) || chr(10) || s_name) AS digest FROM supplier"""
)
def graded_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    bar = F.when(F.col("s_suppkey") % 10 != 0, 5000.0)
    return rows.select("s_suppkey", fn.grade(F.col("s_acctbal"), bar, F.lit(1000.0)).alias("balance"), fn.grade(F.col("s_nationkey"), F.lit(5), F.lit(15), higher_is_better=False).alias("nation"), fn.hashed_key("supplier", F.col("s_suppkey").cast("string"), F.col("s_name")).alias("digest"))


#: The steps that SQL can say; the documents hold no compatibility forms for it to miss.
CANONICAL = r"""WITH s1 AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM rough),
s2 AS (SELECT doc_id, replace(replace(replace(replace(t, 'ﬁ', 'fi'), chr(173), ''), chr(160), ' '), '—', '-') AS t FROM s1),
s3 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g'), '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g') AS t FROM s2),
s4 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1-\2', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1-\2', 'g') AS t FROM s3),
s5 AS (SELECT doc_id, replace(regexp_replace(regexp_replace(t, '\n[ \t]*\n+', chr(1), 'g'), '[ \t]*\n[ \t]*', ' ', 'g'), chr(1), chr(10) || chr(10)) AS t FROM s4),
canonical AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]{2,}', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM s5)"""


@query(with_views(CANONICAL + " SELECT doc_id, t AS text, CAST(length(t) AS INT) AS n_chars FROM canonical", "rough"))
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "rough").select("doc_id", normalize.normalized(F.col("text")).alias("text"))
    return rows.select("doc_id", "text", F.length("text").alias("n_chars"))


@query(with_views(CANONICAL + """ SELECT doc_id, CAST(instr(t, q) - 1 AS INT) AS start, t = '' OR q <> '' AS found, CAST(1 AS INT) AS agrees FROM (SELECT doc_id, t, substr(t, length(t) // 2 + 1, 30) AS q FROM canonical)""", "rough"))
def canonical_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of canonical texts and their places in the source, whose own words, made canonical, are the quote again."""
    rows = view(spark, sf_dir, "rough").select("doc_id", "text", normalize.mapped(F.col("text")).alias("c"))
    middle = F.floor(F.length("c.text") / 2).cast("int")
    rows = rows.withColumn("q", F.substring(F.col("c.text"), middle + 1, F.lit(30)))
    rows = rows.withColumn("span", spans.find_span(F.col("c.text"), F.col("q"))).withColumn("source", normalize.source_span(F.col("c.map"), F.col("span.start"), F.col("span.end")))
    again = normalize.normalized(F.substring(F.col("text"), F.col("source.start") + 1, F.col("source.end") - F.col("source.start")))
    return rows.select("doc_id", F.col("span.start").alias("start"), (F.col("span.how") == "exact").alias("found"), F.when(F.contains(again, F.btrim("q", F.lit(" \n"))), 1).otherwise(0).alias("agrees"))
