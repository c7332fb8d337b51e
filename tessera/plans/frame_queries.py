"""Queries over frames of single reads and tables of signature tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import frames, reads as read_ops, signatures
from tessera.operators.frames import Element
from tessera.operators.signatures import Inputs, Test
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

#: Barcode, linker, barcode, linker, UMI and tail behind an insert of 0 to 3 bases.
BEAD = [
    Element("insert", least=0, most=3, after="read"),
    Element("label1", least=8, most=8, after="insert"),
    Element("linker1", sequence="GTGA", after="label1"),
    Element("label2", least=8, most=8, after="linker1"),
    Element("linker2", sequence="GACA", after="label2"),
    Element("umi", least=6, most=6, after="linker2"),
    Element("tail", bio=True, after="umi"),
]

FRAMES = """tried AS (SELECT read_id, file, seq, k, hamming(substr(seq, k + 9, 4), 'GTGA') AS d1, hamming(substr(seq, k + 21, 4), 'GACA') AS d2 FROM staggered, unnest(range(0, 4)) AS u(k) WHERE length(seq) >= k + 30),
ranked AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY d1 + d2, k) AS n FROM tried WHERE d1 <= 1 AND d2 <= 1),
framed AS (SELECT read_id, file, CAST(k AS INT) AS phase, CAST(d1 + d2 AS INT) AS mismatches, nullif(substr(seq, 1, k), '') AS insert_, substr(seq, k + 1, 8) AS label1, substr(seq, k + 25, 6) AS umi FROM ranked WHERE n = 1)"""


@query(with_views(f"WITH {FRAMES} SELECT s.read_id, f.phase, f.mismatches, CAST(f.phase + 12 AS INT) AS label2_start, f.insert_, f.label1, f.umi FROM staggered s LEFT JOIN framed f USING (read_id)", "staggered"))
def read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.framed(view(spark, sf_dir, "staggered"), BEAD)
    cut = lambda name: frames.bases(BEAD, name)
    return rows.select("read_id", "phase", "mismatches", F.col("windows")["label2"]["start"].alias("label2_start"), cut("insert").alias("insert_"), cut("label1").alias("label1"), cut("umi").alias("umi"))


@query(with_views(f"WITH {FRAMES} SELECT s.file, count(f.insert_) AS n, count(DISTINCT f.insert_) / nullif(count(f.insert_), 0) AS ratio FROM staggered s LEFT JOIN framed f USING (read_id) GROUP BY s.file", "staggered"))
def anchored_distinct_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the insert: a draw of no bases is no observation."""
    return frames.anchored_distinct_ratio(view(spark, sf_dir, "staggered"), BEAD, "insert")


HITS = """strands AS (SELECT file, 0 AS place, label1 AS barcode FROM framed UNION ALL SELECT file, 1, reverse(translate(label1, 'ACGT', 'TGCA')) FROM framed),
counted AS (SELECT file, place, count(*) AS n, count(l.barcode) AS hits FROM strands LEFT JOIN bead_list l USING (barcode) WHERE regexp_matches(strands.barcode, '^[ACGT]+$') GROUP BY file, place),
best AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY hits / n DESC, place) AS r FROM counted WHERE hits > 0),
hit AS (SELECT f.file, CASE WHEN b.place = 1 THEN 'revcomp' ELSE 'forward' END AS strand, coalesce(b.n, 0) AS n, coalesce(b.hits, 0) AS hits FROM (SELECT DISTINCT file FROM staggered) f LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (file))"""


@query(with_views(f"WITH {FRAMES}, {HITS} SELECT * FROM hit", "staggered", "bead_list"))
def anchored_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.anchored_hit_rate(view(spark, sf_dir, "staggered"), BEAD, "label1", view(spark, sf_dir, "bead_list"), 8)


def _search(place: str, low: str, high: str, closed: str) -> str:
    """n and rate by file of reads with GTGA and, eight bases on, GACA, from ``low`` to ``high``."""
    return f"""{place}_s_at AS (SELECT read_id, file, hamming(substr(seq, p + 1, 4), 'GTGA') + hamming(substr(seq, p + 13, 4), 'GACA') <= 1 AS near,
  NOT contains(substr(seq, p + 1, 4) || substr(seq, p + 13, 4), 'N') AS clean FROM staggered, unnest(range({low}, {high} + 1)) AS u(p) WHERE length(seq) >= 16 AND p >= 0 AND p + 16 <= length(seq)),
{place}_s_read AS (SELECT read_id, count(*) AS places, count(*) FILTER (clean) AS good, coalesce(bool_or(near) FILTER (clean), false) AS found FROM {place}_s_at GROUP BY read_id),
{place}_s_told AS (SELECT s.file, CASE WHEN length(seq) < 16 OR r.places > 0 AND (r.good = 0 OR {closed} AND r.good < r.places) THEN NULL ELSE coalesce(r.found, false) END AS found FROM staggered s LEFT JOIN {place}_s_read r USING (read_id)),
{place}_s AS (SELECT file, count(found) AS n, avg(CAST(found AS INT)) AS rate FROM {place}_s_told GROUP BY file)"""


SEARCHES = {"window": ("8", "11", "true"), "open_window": ("10", "length(seq) - 16", "false"), "anywhere": ("0", "length(seq) - 16", "false"), "read_end": ("length(seq) - 16", "length(seq) - 16", "true")}


@query(with_views("WITH " + ", ".join(_search(k, *v) for k, v in SEARCHES.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS place, * FROM {k}_s" for k in SEARCHES), "staggered"))
def motif_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "staggered")
    found = None
    for name, (where, start, end) in {"window": ("window", 8, 11), "open_window": ("window", 10, None), "anywhere": ("anywhere", 0, None), "read_end": ("read_end", 0, None)}.items():
        rows = read_ops.motif_search(reads, "GTGANNNNNNNNGACA", where, start, end).select(F.lit(name).alias("place"), "*")
        found = rows if found is None else found.union(rows)
    return found


TESTS = [
    Test("requires", "segment_length", "bead", length=39, tolerance=1, over_length=60),
    Test("requires", "motif_present", "bead", motif="GTGANNNNNNNNGACA", where="window", start=8, end=11, least=0.6),
    Test("supports", "onlist_hit_rate", "bead", 2.0, element="label1", onlist="beads", least=0.9),
    Test("supports", "onlist_hit_rate", "bead", element="label1", onlist="lost"),
    Test("supports", "distinct_ratio", "bead", element="umi", expect="high"),
    Test("supports", "has_segment", "bead", element="tail"),
    Test("excludes", "has_segment", "bead", start=4, end=8, segment="random"),
    Test("excludes", "base_composition", "bead", start=30, base="A", least=0.8),
    Test("supports", "header_index"),
]


def _told(number: int, body: str, lost: str = "('abstain', 0.0, false, false)") -> str:
    """A test's rows for all files from a SELECT of file, outcome, score, answerable, admits; ``lost`` for files without."""
    t = TESTS[number]
    over = t.kind == "segment_length" and t.over_length is not None
    role = "NULL" if t.role is None else f"'{t.role}'"
    names = ("outcome", "score", "answerable", "admits")
    values = lost.strip("()").split(", ")
    return f"""SELECT {number} AS test, CAST({role} AS VARCHAR) AS role, '{t.kind}' AS kind, '{t.use}' AS use, CAST({t.weight} AS DOUBLE) AS weight, CAST({t.length if over else 'NULL'} AS INT) AS low, CAST({t.over_length if over else 'NULL'} AS INT) AS high,
  f.file, {', '.join(f'coalesce(x.{n}, {v}) AS {n}' for n, v in zip(names, values, strict=True))} FROM files f LEFT JOIN ({body}) x USING (file)"""


def _verdict(value: str, passes: str, score: str, source: str, admits: str = "false") -> str:
    return f"SELECT file, CASE WHEN {value} IS NULL THEN 'abstain' WHEN {passes} THEN 'pass' ELSE 'fail' END AS outcome, CASE WHEN {value} IS NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, {score})), 9) END AS score, {value} IS NOT NULL AS answerable, {admits} AS admits FROM {source}"


_NOTHING = "SELECT NULL AS file, NULL AS outcome, NULL AS score, NULL AS answerable, NULL AS admits WHERE false"

TABLE_SQL = f"""WITH {FRAMES}, {HITS}, {_search("motif", "8", "11", "true")},
files AS (SELECT DISTINCT file FROM staggered UNION ALL SELECT 'none'),
b AS (SELECT file, i - 1 AS cycle, substr(seq, i, 1) AS b FROM staggered, unnest(range(1, length(seq) + 1)) AS t(i)),
c AS (SELECT file, cycle, count(*) AS n, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t FROM b GROUP BY file, cycle),
l AS (SELECT file, length(seq) AS mode, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, length(seq)) AS k FROM staggered GROUP BY file, length(seq)),
rate AS (SELECT file, coalesce(hits / nullif(n, 0), 0.0) AS rate, (SELECT count(*) FROM bead_list) / 65536 AS floor FROM hit),
umis AS (SELECT s.file, count(DISTINCT f.umi) / nullif(count(f.umi), 0) AS ratio FROM staggered s LEFT JOIN framed f USING (read_id) GROUP BY s.file),
random AS (SELECT file, avg(greatest(a, c, g, t) / n) FILTER (cycle >= 4 AND cycle < 8) AS share FROM c GROUP BY file),
composed AS (SELECT file, avg(a / n) FILTER (cycle >= 30) AS share FROM c GROUP BY file)
{_told(0, _verdict("mode", "mode >= 60 OR abs(mode - 39) <= 1", "CASE WHEN mode >= 60 THEN 1.0 ELSE 1 - abs(mode - 39) / 3.9 END", "(SELECT * FROM l WHERE k = 1)"), "('fail', 0.0, true, false)")}
UNION ALL {_told(1, _verdict("rate", "rate >= 0.6", "rate / 0.6", "motif_s"))}
UNION ALL {_told(2, _verdict("rate", "rate >= 0.9", "(rate - floor) / (0.9 - floor)", "rate", "rate >= greatest(0.05, floor * 50)"), "('fail', 0.0, true, false)")}
UNION ALL {_told(3, _NOTHING, "('abstain', 0.0, true, false)")}
UNION ALL {_told(4, "SELECT file, 'abstain' AS outcome, round(coalesce(ratio, 0.0), 9) AS score, ratio IS NOT NULL AS answerable, false AS admits FROM umis")}
UNION ALL {_told(5, _NOTHING)}
UNION ALL {_told(6, _verdict("share", "share <= 0.55", "(0.55 - share) / 0.3", "random"))}
UNION ALL {_told(7, _verdict("share", "share >= 0.8", "share / 0.8", "composed"))}
UNION ALL {_told(8, _NOTHING)}"""


@query(with_views(TABLE_SQL, "staggered", "bead_list"))
def signature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests of a signature over all files, one of which has no reads."""
    reads = view(spark, sf_dir, "staggered").select("file", "seq")
    files = reads.select("file").distinct().union(spark.range(1).select(F.lit("none")))
    return signatures.evaluate(TESTS, {"bead": BEAD}, Inputs(reads, files, onlists={"beads": (view(spark, sf_dir, "bead_list"), 8)}))
