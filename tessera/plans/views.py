"""Deterministic projections of the driver's tables into the operators' inputs, in Spark and as DuckDB SQL.

Each view is one SELECT that both engines read alike, but for the name of the text type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LETTERS = "'0123456789abcdef', 'ACGTACGTACGTACGT'"

#: name: (tables it reads, SELECT)
VIEWS: dict[str, tuple[list[str], str]] = {
    "reads": (
        ["orders"],
        f"""SELECT read_id, file, CASE WHEN read_id % 13 = 0 THEN substr(s, 1, 9) || 'N' || substr(s, 11) ELSE s END AS seq
        FROM (SELECT o_orderkey AS read_id, o_orderstatus AS file, 'ACGTAC' || substr(translate(md5(CAST(o_orderkey % 4000 AS VARCHAR)), {_LETTERS}), 1, CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE 16 END) || 'TTTTTTTT' AS s FROM orders) t""",
    ),
    "onlist": (["orders"], f"SELECT DISTINCT substr(translate(md5(CAST(o_orderkey % 4000 AS VARCHAR)), {_LETTERS}), 1, 8) AS barcode FROM orders WHERE o_orderkey % 4 <> 0"),
    # barcode, linker, barcode, linker, UMI and tail behind 0 to 3 inserted bases; some reads cut short, garbled, or uncalled at a place
    "staggered": (
        ["orders"],
        f"""SELECT read_id, file, CASE WHEN read_id % 17 = 0 THEN substr(s, 1, 24) WHEN read_id % 19 = 0 THEN translate(s, 'GT', 'CA') WHEN read_id % 13 = 0 THEN substr(s, 1, 5) || 'N' || substr(s, 7) WHEN read_id % 11 = 0 THEN substr(s, 1, 10) || 'N' || substr(s, 12) ELSE s END AS seq
        FROM (SELECT o_orderkey AS read_id, o_orderstatus AS file, substr('ACG', 1, CAST(o_orderkey % 4 AS INT)) || substr(translate(md5(CAST(o_orderkey % 50 AS VARCHAR)), {_LETTERS}), 1, 8) || CASE o_orderkey % 7 WHEN 0 THEN 'GTCA' ELSE 'GTGA' END
          || substr(translate(md5(CAST(o_orderkey % 50 AS VARCHAR)), {_LETTERS}), 9, 8) || 'GACA' || substr(translate(md5(CAST(o_orderkey AS VARCHAR)), {_LETTERS}), 1, 6) || 'TTTTTT' AS s FROM orders) t""",
    ),
    "bead_list": (["orders"], f"SELECT DISTINCT substr(translate(md5(CAST(o_orderkey % 50 AS VARCHAR)), {_LETTERS}), 1, 8) AS barcode FROM orders WHERE o_orderkey % 5 <> 0"),
    "names": (["orders"], "SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 7 = 0 THEN '@SRR' || CAST(o_orderkey AS VARCHAR) || '.1' ELSE '@INST' || CAST(o_custkey % 4 AS VARCHAR) || ':' || CAST(o_custkey AS VARCHAR) || ':FC' || CAST(o_orderkey % 9 AS VARCHAR) || ':' || CAST(o_orderkey % 8 AS VARCHAR) || ':' || CAST(1000 + o_orderkey % 50 AS VARCHAR) || ':1:2 1:N:0' || CASE WHEN o_orderkey % 5 = 0 THEN ' ACGTAC+TTTTTT' ELSE ':ACGT' END END AS name FROM orders"),
    "spans": (["events"], "SELECT event_id, user_id AS contig, event_id * 37 % 100000 AS start, event_id * 37 % 100000 + event_id * 7919 % 400 AS \"end\", event_type FROM events"),
    "umis": (
        ["lineitem"],
        f"""SELECT l_suppkey AS cell, CAST(l_linenumber AS BIGINT) AS gene, CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE substr(translate(md5(CAST(l_orderkey % 500 AS VARCHAR)), {_LETTERS}), 1, 5) END AS umi,
        CASE WHEN l_partkey % 3 = 0 THEN 'intron' ELSE 'exon' END AS region, 1 + l_partkey % 4 AS hits FROM lineitem""",
    ),
    "hierarchy": (
        ["region", "nation", "customer", "orders"],
        """SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS accession, CAST(NULL AS VARCHAR) AS parent, 'project' AS level FROM region
        UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 'sample' FROM nation
        UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'N' || CAST(c_nationkey AS VARCHAR), 'experiment' FROM customer
        UNION ALL SELECT 'O' || CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'C' || CAST(o_custkey AS VARCHAR) END, 'run' FROM orders""",
    ),
    "claims": (
        ["customer"],
        """SELECT c_custkey AS subject, 'segment' AS attribute, c_mktsegment AS value, 'asserted' AS basis, 'paper' AS source, true AS declared FROM customer
        UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END, 'asserted', CASE WHEN c_custkey % 2 = 0 THEN 'paper' ELSE 'record' END, false FROM customer
        UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR), 'inferred', 'record', false FROM customer
        UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey + 1 AS VARCHAR), 'observed', 'bytes', true FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey, 'band', CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END, 'user_confirmed', 'user', true FROM customer WHERE c_custkey % 5 = 0""",
    ),
    "cards": (["customer"], "SELECT c_custkey AS id, 'sample ' || c_name || '. segment: ' || c_mktsegment || '. nation ' || CAST(c_nationkey AS VARCHAR) AS text FROM customer"),
    "quotes": (
        ["customer"],
        """SELECT id * 3 AS claim, id AS doc, 'segment' AS quote, instr(text, 'segment') - 1 AS start, instr(text, 'segment') + 6 AS "end", true AS per_record FROM (SELECT c_custkey AS id, 'sample ' || c_name || '. segment: ' || c_mktsegment AS text FROM customer) t
        UNION ALL SELECT c_custkey * 3 + 1, c_custkey, c_mktsegment, 17 + length(c_name) + 2, 17 + length(c_name) + 2 + length(c_mktsegment), true FROM customer
        UNION ALL SELECT c_custkey * 3 + 2, c_custkey, 'sample', 0, 6, false FROM customer""",
    ),
    # documents as a bad extraction gives them: wrapped and hyphenated lines, ligatures, curly marks, odd spaces, blank lines of spaces
    "rough": (
        ["documents"],
        """SELECT doc_id, '  3-' || chr(10) || 'prime' || chr(9) || chr(9) || 'kit ' || chr(10) || chr(10) || replace(replace(replace(replace(replace(replace(text, ' the ', ' t' || chr(173) || 'he' || chr(160) || ' '), 'ti', 'ﬁ'), ' of ', chr(13) || chr(10) || 'of '),
          'an', 'a-' || chr(10) || 'n'), '. ', '.' || chr(10) || ' ' || chr(10)), ', ', ' ' || '—' || chr(9) || chr(13)) || chr(10) AS text FROM documents""",
    ),
    "quoted": (["documents"], "SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN substr(text, 11, 20) WHEN 1 THEN replace(substr(text, 11, 20), ' ', '  ') WHEN 2 THEN replace(substr(text, 11, 60), chr(10), ' ') WHEN 3 THEN '  ' ELSE 'no such (quote)' END AS q FROM documents"),
    "drafts": (
        ["customer"],
        """SELECT c_custkey AS draft, CASE WHEN c_custkey % 11 = 0 THEN -c_custkey ELSE c_custkey END AS doc, c_mktsegment AS segment, CASE WHEN c_custkey % 13 = 0 THEN 'secret' WHEN c_custkey % 17 = 0 THEN 'steer' WHEN c_custkey % 2 = 0 THEN 'kind' ELSE 'topic' END AS field,
        CASE c_custkey % 5 WHEN 0 THEN 'zzz' WHEN 1 THEN 'MAKER' WHEN 2 THEN 'sample' ELSE c_mktsegment END AS value, CASE c_custkey % 7 WHEN 0 THEN 'not there' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'segment:  ' || c_mktsegment WHEN 3 THEN substr(c_mktsegment, 2, 4) WHEN 4 THEN 'sample ' || c_name ELSE 'segment: ' || c_mktsegment || '.' END AS quote FROM customer""",
    ),
    "depths": (["lineitem"], "SELECT l_suppkey AS sample, l_linenumber AS run, l_returnflag AS file, CASE WHEN l_suppkey % 17 = 0 AND l_linenumber = 3 THEN NULL ELSE count(*) END AS reads FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag"),
    "candidates": (["part"], "SELECT p_partkey, p_brand AS dataset, p_name || '-' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_size * 10 + p_partkey % 7 AS DOUBLE) / 500 AS value, p_partkey % 8 AS rung, p_partkey % 11 = 0 AS hit FROM part"),
    "file_names": (["orders"], "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'SRR' || CAST(o_orderkey AS VARCHAR) || '_' || CAST(1 + o_orderkey % 2 AS VARCHAR) || '.fastq.gz' WHEN 1 THEN 's' || CAST(o_custkey AS VARCHAR) || '_L00' || CAST(1 + o_orderkey % 4 AS VARCHAR) || '_R1_001.fastq.gz' WHEN 2 THEN 's' || CAST(o_custkey AS VARCHAR) || '_I2.fq' ELSE 'plain_' || CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 5 WHEN 0 THEN '_r1' WHEN 1 THEN '.R3_001' WHEN 2 THEN '_read-2' WHEN 3 THEN '_R1_y_2' ELSE '' END || '.FASTQ' END AS name FROM orders"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a view; its base tables are read with the columns the SELECT names."""
    tables, sql = VIEWS[name]
    return sql_rows(spark, sf_dir, sql, *tables)


def sql_rows(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of a SELECT that both engines read alike, over these tables."""
    text = re.sub(r'"(end|case)"', r"`\1`", sql.replace("VARCHAR", "STRING"))
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = text.replace("{", "{{").replace("}", "}}")  # tables alone are named in braces
    for t in tables:
        text = _named(text, t)
    return spark.sql(text, **args)


def _named(sql: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it needs in front."""
    head = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
