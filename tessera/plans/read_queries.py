"""Queries over reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sequence
from tessera.operators import observation
from tessera.operators import reads as ops
from tessera.plans.registry import query
from tessera.plans.views import view, with_views
from tessera.scratch import stored

CYCLES = """
cells AS (SELECT file, i - 1 AS cycle, substr(seq, i, 1) AS b FROM reads, unnest(range(1, length(seq) + 1)) AS u(i)),
cycles AS (
  SELECT file, cycle, count(*) AS n, count(*) FILTER (b = 'A') AS n_a, count(*) FILTER (b = 'C') AS n_c, count(*) FILTER (b = 'G') AS n_g,
    count(*) FILTER (b = 'T') AS n_t, count(*) FILTER (b NOT IN ('A', 'C', 'G', 'T')) AS n_n
  FROM cells GROUP BY file, cycle)"""
BASE = "CASE greatest(n_a, n_c, n_g, n_t) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' ELSE 'T' END"


@query(with_views(f"WITH {CYCLES} SELECT * FROM cycles", "reads"))
def per_cycle_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.per_cycle_composition(view(spark, sf_dir, "reads"))


@query(
    with_views(
        f"""WITH {CYCLES}, t AS (SELECT *, n_a + n_c + n_g + n_t AS s FROM cycles)
SELECT file, cycle, {BASE} AS base,
  round(0.0 {"".join(f" - CASE WHEN n_{b} > 0 THEN n_{b} / s * log2(n_{b} / s) ELSE 0.0 END" for b in "acgt")}, 9) AS bits FROM t""",
        "reads",
    )
)
def cycle_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cycle_profile(ops.per_cycle_composition(view(spark, sf_dir, "reads")))


@query(
    with_views(
        f"WITH {CYCLES} SELECT file, CAST(sum(n) AS DOUBLE) / (max(n) * count(*)) AS reach, CAST(sum(n) - sum(n_n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS called FROM cycles GROUP BY file", "reads"
    )
)
def head_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.head_coverage(ops.per_cycle_composition(view(spark, sf_dir, "reads")))


@query(
    with_views(
        """WITH l AS (SELECT file, length(seq) AS length FROM reads),
c AS (SELECT file, length, count(*) AS c FROM l GROUP BY file, length),
m AS (SELECT file, arg_max(length, c * 1000000 - length) AS mode, max(c) AS mc, count(*) AS n_distinct FROM c GROUP BY file),
s AS (SELECT file, list_sort(list(length)) AS s, count(*) AS n FROM l GROUP BY file)
SELECT file, CAST(mode AS INTEGER) AS mode, mc / n AS mode_share, n_distinct, CAST(s[1] AS INTEGER) AS min_length, CAST(s[n] AS INTEGER) AS max_length,
  CAST(CASE WHEN n_distinct > 1 THEN s[greatest(0, n // 100 - 1) + 1] END AS INTEGER) AS p1,
  CAST(CASE WHEN n_distinct > 1 THEN s[n // 2 + 1] END AS INTEGER) AS p50, CAST(CASE WHEN n_distinct > 1 THEN s[least(n - 1, n * 99 // 100) + 1] END AS INTEGER) AS p99
FROM s JOIN m USING (file)""",
        "reads",
    )
)
def read_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.read_length_profile(view(spark, sf_dir, "reads"))


@query(with_views("SELECT file, count(*) FILTER (length(seq) >= 22) AS n, count(DISTINCT CASE WHEN length(seq) >= 22 THEN substr(seq, 7, 16) END) / nullif(count(*) FILTER (length(seq) >= 22), 0) AS ratio FROM reads GROUP BY file", "reads"))
def distinct_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_ratio(view(spark, sf_dir, "reads"), 6, 22)


CONSENSUS = """
cells AS (SELECT file, i AS cycle, substr(seq, 4 + i, 1) AS b FROM reads, unnest(range(1, 9)) AS u(i) WHERE length(seq) >= 12),
counts AS (SELECT file, cycle, count(*) FILTER (b = 'A') AS n_a, count(*) FILTER (b = 'C') AS n_c, count(*) FILTER (b = 'G') AS n_g, count(*) FILTER (b = 'T') AS n_t FROM cells GROUP BY file, cycle),
consensus AS (SELECT file, string_agg(CASE greatest(n_a, n_c, n_g, n_t) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' ELSE 'T' END, '' ORDER BY cycle) AS consensus FROM counts GROUP BY file)"""


@query(with_views(f"WITH {CONSENSUS} SELECT * FROM consensus", "reads"))
def modal_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.modal_consensus(view(spark, sf_dir, "reads"), 4, 12)


@query(
    with_views(
        f"WITH {CONSENSUS} SELECT file, consensus, count(*) AS n, avg(CASE WHEN hamming(substr(seq, 5, 8), consensus) <= 4 THEN 1.0 ELSE 0.0 END) AS rate FROM reads JOIN consensus USING (file) WHERE length(seq) >= 12 GROUP BY file, consensus", "reads"
    )
)
def consensus_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.consensus_match_rate(view(spark, sf_dir, "reads"), 4, 12, 4)


@query(
    with_views(
        f"""WITH {CYCLES},
p AS (SELECT file, cycle, CASE WHEN n_a + n_c + n_g + n_t > 0 AND greatest(n_a, n_c, n_g, n_t) >= (n_a + n_c + n_g + n_t) * 0.9 THEN {BASE} ELSE '.' END AS b FROM cycles),
i AS (SELECT *, cycle - row_number() OVER (PARTITION BY file, b ORDER BY cycle) AS island FROM p),
k AS (SELECT *, CASE WHEN b = '.' THEN 'random' WHEN count(*) OVER (PARTITION BY file, b, island) >= 4 THEN 'homopolymer' || b ELSE 'constant' END AS kind FROM i),
g AS (SELECT *, CASE WHEN kind <> lag(kind) OVER (PARTITION BY file ORDER BY cycle) THEN 1 ELSE 0 END AS step FROM k),
r AS (SELECT *, sum(step) OVER (PARTITION BY file ORDER BY cycle) AS part FROM g)
SELECT file, min(cycle) AS start, max(cycle) + 1 AS "end", regexp_extract(kind, '^(constant|homopolymer|random)', 1) AS kind, CASE WHEN kind <> 'random' THEN string_agg(b, '' ORDER BY cycle) END AS bases
FROM r GROUP BY file, part, r.kind""",
        "reads",
    )
)
def cycle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segments(ops.per_cycle_composition(view(spark, sf_dir, "reads")))

#: The runs of cycles of every file, over the view reads.
SEGMENTS = f"""{CYCLES},
p AS (SELECT file, cycle, CASE WHEN n_a + n_c + n_g + n_t > 0 AND greatest(n_a, n_c, n_g, n_t) >= (n_a + n_c + n_g + n_t) * 0.9 THEN {BASE} ELSE '.' END AS b FROM cycles),
i AS (SELECT *, cycle - row_number() OVER (PARTITION BY file, b ORDER BY cycle) AS island FROM p),
k AS (SELECT *, CASE WHEN b = '.' THEN 'random' WHEN count(*) OVER (PARTITION BY file, b, island) >= 4 THEN 'homopolymer' || b ELSE 'constant' END AS kind FROM i),
g AS (SELECT *, CASE WHEN kind <> lag(kind) OVER (PARTITION BY file ORDER BY cycle) THEN 1 ELSE 0 END AS step FROM k),
r AS (SELECT *, sum(step) OVER (PARTITION BY file ORDER BY cycle) AS part FROM g),
segs AS (SELECT file, min(cycle) AS start, max(cycle) + 1 AS "end", regexp_extract(kind, '^(constant|homopolymer|random)', 1) AS kind, CASE WHEN kind <> 'random' THEN string_agg(b, '' ORDER BY cycle) END AS bases FROM r GROUP BY file, part, r.kind)"""


@query(
    with_views(
        f"""WITH {SEGMENTS},
lens AS (SELECT file, length(seq) AS l, count(*) AS n FROM reads GROUP BY file, length(seq)),
sizes AS (SELECT file, CAST(sum(n) AS BIGINT) AS n_reads, CAST(arg_max(l, n * 1000 - l) AS INT) AS mode_length, CAST(min(l) AS INT) AS least_length, CAST(max(l) AS INT) AS most_length FROM lens GROUP BY file),
head AS (SELECT file, CAST(count(*) AS INT) AS n_cycles, sum(n) AS reached, sum(n - n_n) AS called FROM cycles GROUP BY file),
cover AS (SELECT s.file, s.start, s."end", kind, bases, sum(n - n_n) / (any_value(n_reads) * (any_value(s."end") - any_value(s.start))) AS coverage FROM segs s JOIN sizes USING (file) JOIN cycles c ON c.file = s.file AND c.cycle >= s.start AND c.cycle < s."end" GROUP BY s.file, s.start, s."end", kind, bases),
listed AS (SELECT file, string_agg(start || '-' || "end" || ' ' || kind || ' ' || coalesce(bases, '') || ' ' || CAST(round(coverage * 1000000) AS BIGINT), ';' ORDER BY start) AS segments FROM cover GROUP BY file),
cut AS (SELECT s.file, s.start, s."end", count(*) AS n, count(DISTINCT substr(seq, s.start + 1, s."end" - s.start)) / count(*) AS ratio FROM segs s JOIN reads USING (file) WHERE kind = 'random' AND length(seq) >= s."end" GROUP BY s.file, s.start, s."end"),
windows AS (SELECT file, string_agg(start || '-' || "end" || ' ' || n || ' ' || CAST(round(ratio * 1000000) AS BIGINT), ';' ORDER BY start) AS windows FROM cut GROUP BY file)
SELECT file, n_reads, mode_length, least_length, most_length, n_cycles, round(reached / (n_reads * n_cycles), 9) AS reach, round(called / reached, 9) AS called, segments, coalesce(windows, '') AS windows
FROM sizes JOIN head USING (file) JOIN listed USING (file) LEFT JOIN windows USING (file)""",
        "reads",
    )
)
def file_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of every file at once."""
    rows = observation.observations(stored(view(spark, sf_dir, "reads").select("file", "seq"), "reads"))
    parts = lambda s, *more: F.concat(s.start.cast("string"), F.lit("-"), s.end.cast("string"), *(x for m in more for x in (F.lit(" "), m)))
    millionths = lambda x: F.round(x * 1000000).cast("long").cast("string")
    segments = F.array_join(F.transform("segments", lambda s: parts(s, s.kind, F.coalesce(s.bases, F.lit("")), millionths(s.coverage))), ";")
    windows = F.array_join(F.transform(F.coalesce("windows", F.array().cast("array<struct<start:bigint,end:bigint,n:bigint,ratio:double>>")), lambda s: parts(s, s.n.cast("string"), millionths(s.ratio))), ";")
    return rows.withColumns({"segments": segments, "windows": windows})



@query(
    with_views(
        """WITH w AS (SELECT read_id, substr(seq, 7, 12) AS w FROM reads WHERE length(seq) >= 18)
SELECT read_id, w AS bases, reverse(translate(w, 'ACGT', 'TGCA')) AS revcomp,
  CASE WHEN regexp_matches(w, '^[ACGT]+$') THEN list_sum(list_transform(range(1, 13), lambda i: CAST(instr('ACGT', substr(w, i, 1)) - 1 AS BIGINT) * CAST(pow(4, 12 - i) AS BIGINT)))::BIGINT END AS code,
  CASE WHEN regexp_matches(w, '^[ACGT]+$') THEN w END AS unpacked, hamming(w, 'ACGTACGTACGT')::INTEGER AS distance
FROM w""",
        "reads",
    )
)
def packed_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "reads").select("read_id", sequence.window(F.col("seq"), 6, 18).alias("bases")).where("bases is not null")
    rows = rows.withColumn("code", sequence.packed(F.col("bases")))
    return rows.select("read_id", "bases", sequence.reverse_complement(F.col("bases")).alias("revcomp"), F.col("code").cast("long").alias("code"), sequence.unpacked(F.col("code"), 12).alias("unpacked"), sequence.hamming(F.col("bases"), F.lit("ACGTACGTACGT")).alias("distance"))


@query(
    with_views(
        """WITH c AS (SELECT file, substr(seq, 5, 1) AS a, substr(seq, 6, 1) AS b, substr(seq, 10, 1) AS d FROM reads WHERE length(seq) >= 10),
m AS (SELECT file, CASE WHEN a IN ('A', 'C', 'G', 'T') AND b IN ('A', 'C', 'G', 'T') AND d IN ('A', 'C', 'G', 'T') THEN (CASE WHEN a = 'A' THEN 0 ELSE 1 END) + (CASE WHEN b IN ('C', 'T') THEN 0 ELSE 1 END) + (CASE WHEN d IN ('A', 'G') THEN 0 ELSE 1 END) END AS off FROM c)
SELECT file, count(off) AS n, avg(CASE WHEN off IS NULL THEN NULL WHEN off <= 0 THEN 1.0 ELSE 0.0 END) AS rate FROM m GROUP BY file""",
        "reads",
    )
)
def motif_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.motif_rate(view(spark, sf_dir, "reads"), "AYNNNR", 4, 0)


@query(
    with_views(
        """WITH p AS (SELECT s, o, s * 5 + o + 2 AS place FROM unnest([0, 1]) AS a(s), unnest([-2, -1, 0, 1, 2]) AS b(o)),
w AS (SELECT file, place, CASE WHEN s = 0 THEN substr(seq, 7 + o, 8) ELSE reverse(translate(substr(seq, 7 + o, 8), 'ACGT', 'TGCA')) END AS barcode FROM reads, p WHERE length(seq) >= 14 + o),
h AS (SELECT file, place, count(*) AS n, count(onlist.barcode) AS hits FROM w LEFT JOIN onlist USING (barcode) WHERE regexp_matches(w.barcode, '^[ACGT]+$') GROUP BY file, place),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY hits / n DESC, place) AS k FROM h)
SELECT file, CASE WHEN place > 4 THEN 'revcomp' ELSE 'forward' END AS strand, CAST(place % 5 - 2 AS INTEGER) AS "offset", n, hits FROM r WHERE k = 1""",
        "reads",
        "onlist",
    )
)
def onlist_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.onlist_hit_rate(view(spark, sf_dir, "reads"), view(spark, sf_dir, "onlist"), 6, 8)


@query(
    with_views(
        """WITH a AS (SELECT DISTINCT substr(seq, 7, 8) AS barcode FROM reads),
c AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM onlist) AS n_b, (SELECT count(*) FROM a JOIN onlist USING (barcode)) AS shared)
SELECT n_a, n_b, shared, shared / least(n_a, n_b) AS fraction FROM c""",
        "reads",
        "onlist",
    )
)
def onlist_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.intersect_fraction(view(spark, sf_dir, "reads").select(F.substring("seq", 7, 8).alias("barcode")), view(spark, sf_dir, "onlist"))


@query(
    with_views(
        """WITH s AS (SELECT read_id, regexp_replace(name, '^@', '') AS name FROM names),
h AS (SELECT *, regexp_matches(name, '^[SED]RR\\d+\\.\\d+') AS sra, string_split(name, ':') AS h FROM s),
p AS (SELECT *, NOT sra AND len(h) >= 7 AS parsed, try_cast(h[4] AS INTEGER) AS lane, try_cast(h[5] AS INTEGER) AS tile FROM h)
SELECT read_id, parsed, sra AS sra_normalized, CASE WHEN parsed THEN h[1] END AS instrument, CASE WHEN parsed THEN h[2] END AS run, CASE WHEN parsed THEN h[3] END AS flowcell,
  CASE WHEN parsed AND tile IS NOT NULL THEN lane END AS lane, CASE WHEN parsed AND lane IS NOT NULL THEN tile END AS tile,
  CASE WHEN parsed THEN nullif(regexp_extract(name, '[ /]([ACGTN]{6,})(\\+[ACGTN]{6,})?\\s*$', 1), '') END AS "index" FROM p""",
        "names",
    )
)
def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "names").select("read_id", sequence.read_name(F.col("name")).alias("n")).select("read_id", "n.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'unknown' WHEN 33 + p_size < 64 THEN 'phred33' WHEN 33 + p_size + p_partkey % 40 > 74 THEN 'phred64' ELSE 'unknown' END AS encoding FROM part")
def quality_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth part has no least quality."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    least = F.when(F.col("p_partkey") % 9 != 0, 33 + F.col("p_size"))
    return part.select("p_partkey", sequence.quality_encoding(least, 33 + F.col("p_size") + F.col("p_partkey") % 40).alias("encoding"))


#: The tag of the queries: an anchor, a UMI of six bases, a motif with one substitution at most.
TAG = {"anchor": "AC", "trailing": "TTG", "start": 0, "umi": (2, 6), "trail": 8, "cdna": 11}
TAGGED = """
hits AS (
  SELECT read_id, min(k) AS place FROM reads, unnest(range(25)) AS t(k)
  WHERE substr(seq, k + 1, 2) = 'AC' AND length(seq) > k + 11
    AND CAST(substr(seq, k + 9, 1) <> 'T' AS INTEGER) + CAST(substr(seq, k + 10, 1) <> 'T' AS INTEGER) + CAST(substr(seq, k + 11, 1) <> 'G' AS INTEGER) <= 1
  GROUP BY read_id),
tags AS (
  SELECT read_id, file, CASE WHEN place IS NULL THEN seq ELSE substr(seq, place + 12) END AS seq, place IS NOT NULL AS tagged, CAST(place AS INTEGER) AS start, substr(seq, place + 3, 6) AS umi
  FROM reads LEFT JOIN hits USING (read_id))"""


@query(with_views(f"WITH {TAGGED} SELECT * FROM tags", "reads"))
def tag_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extract_tags(view(spark, sf_dir, "reads"), **TAG)


@query(
    with_views(
        f"""WITH {TAGGED}, n AS (SELECT file, count(*) AS reads, count(*) FILTER (tagged) AS tagged, count(*) FILTER (tagged AND start <> 0) AS drifted FROM tags GROUP BY file)
SELECT *, tagged / reads AS tagged_share, CASE WHEN tagged > 0 THEN drifted / tagged END AS drift_share FROM n""",
        "reads",
    )
)
def tag_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tag_profile(ops.extract_tags(view(spark, sf_dir, "reads"), **TAG), start=TAG["start"])
