"""Operators without a SQL form, and awkward rows, against brute force."""

from __future__ import annotations

import gzip
import random

from pyspark.sql import functions as F

from tessera.functions import normalize, sequence, text
from tessera.operators import intervals, metrics, molecules, reads, records, spans
from tessera.sources import fastq, tables


def near(a, b):
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def brute_umis(counts):
    total, gone = dict(counts), set()
    for seed in sorted(counts, key=lambda u: (-counts[u], u)):
        if seed not in gone:
            for u in sorted(counts):
                if u not in gone and near(u, seed) and 2 * counts[u] - 1 <= counts[seed]:
                    gone.add(u)
                    total[seed] += counts[u]
    return {u: n for u, n in total.items() if u not in gone}


def test_umi_correction(spark):
    rng = random.Random(3)
    rows, want = [], []
    buckets = [{"AAAAAAAA": 9, "AAAAAAAT": 1}, {"AAAAAAAA": 2, "AAAAAAAT": 2}, {"AAAAAAAA": 9, "AAAAAATT": 1}, {"TTTTTTTT": 3, "AAAAAAAA": 3}]
    buckets += [{"".join(rng.choice("ACG") for _ in range(4)): rng.randrange(1, 9) for _ in range(30)} for _ in range(8)]
    for cell, bucket in enumerate(buckets):
        rows += [(cell, 1, u, n) for u, n in bucket.items()]
        want += [(cell, 1, u, n) for u, n in brute_umis(bucket).items()]
    got = molecules.correct_umis(spark.createDataFrame(rows, "cell long, gene long, umi string, n long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_layers_correct_the_union(spark):
    rows = [(1, 1, "AAAA", "exon")] * 2 + [(1, 1, "AAAT", "intron")] + [(1, 1, "", "exon"), (1, 1, None, "exon")]
    got = {(r.layer): r.molecules for r in molecules.molecule_layers(spark.createDataFrame(rows, "cell long, gene long, umi string, region string")).collect()}
    assert got == {"exon": 1, "intron": 1, "all": 1}


def test_greedy_batches(spark):
    rows = [("k", i, sha, n) for i, (sha, n) in enumerate([("a", 10), ("b", 10), ("a", 10), ("c", 90), ("d", 20), ("e", 1), ("f", 1), ("g", 1)])] + [("l", 0, "a", 999)]
    got = metrics.greedy_batches(spark.createDataFrame(rows, "key string, ordinal long, sha string, chars long"), 3, 100)
    assert sorted(tuple(r) for r in got.collect()) == [("k", 0, 0), ("k", 1, 0), ("k", 2, 1), ("k", 3, 1), ("k", 4, 2), ("k", 5, 2), ("k", 6, 2), ("k", 7, 3), ("l", 0, 0)]


def test_interval_edges(spark):
    rows = [(1, 10, 40, "g0"), (1, 10, 40, "g1"), (1, 10, 25, "g2"), (1, 25, 60, "g3"), (1, 40, 40, "g4"), (1, 70, 90, "g5")]
    genes = spark.createDataFrame(rows, "contig long, start long, end long, gene string")
    for lo, hi, want in ((0, 10, ""), (10, 11, "g0 g1 g2"), (24, 26, "g0 g1 g2 g3"), (40, 41, "g3"), (60, 70, ""), (0, 100, "g0 g1 g2 g3 g5")):
        for width in (1, 7, 1000):
            probe = spark.createDataFrame([(1, lo, hi)], "contig long, start long, end long")
            assert " ".join(sorted(r.r_gene for r in intervals.overlaps(probe, genes, width).collect())) == want
    got = [(r.start, r.end, r.n) for r in intervals.merged(genes).orderBy("start").collect()]
    assert got == [(10, 60, 4), (70, 90, 1)]


def test_merged_over_blocks(spark):
    rng = random.Random(2)
    spans_ = [(k % 2, s, s + rng.randrange(0, 3 << 20)) for k in range(60) for s in [rng.randrange(1 << 26)]]
    want = []
    for contig in (0, 1):
        end = None
        for s, e in sorted((s, e) for c, s, e in spans_ if c == contig and s < e):
            if end is None or s > end:
                want.append([contig, s, e])
            want[-1][2] = max(want[-1][2], e)
            end = want[-1][2]
    got = intervals.merged(spark.createDataFrame(spans_, "contig long, start long, end long"))
    assert sorted([r.contig, r.start, r.end] for r in got.collect()) == sorted(want)


def test_reads_without_bases(spark):
    rows = spark.createDataFrame([("f", None), ("f", ""), ("g", "ACG"), ("g", "AC")], "file string, seq string")
    assert {r.file for r in reads.per_cycle_composition(rows).collect()} == {"g"}
    profile = {r.file: r for r in reads.read_length_profile(rows.where("seq is not null")).collect()}
    assert (profile["f"].mode, profile["f"].p50, profile["g"].mode, profile["g"].p50) == (0, None, 2, 3)
    assert reads.per_cycle_composition(rows.limit(0)).collect() == []
    ratio = {r.file: r.ratio for r in reads.distinct_ratio(rows, 0, 3).collect()}
    assert ratio == {"f": None, "g": 1.0}


def test_sequence_functions(spark):
    wide = "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT"
    rows = spark.createDataFrame([("ACGT",), ("ACNT",), ("",), (wide,), (None,)], "s string")
    got = [r.c for r in rows.select(sequence.packed(F.col("s")).alias("c")).collect()]
    assert [None if c is None else int(c) for c in got] == [27, None, None, 4**32 - 1, None]
    far = rows.select(sequence.hamming(F.col("s"), F.lit("ACCTA")).alias("d")).collect()
    assert [r.d for r in far] == [2, 2, 5, 4 + 27, None]


def test_text_functions(spark):
    rows = spark.createDataFrame([("Single-cell RNA", "rna single"), ("abc", "the"), ("x", "")], "t string, f string")
    got = [r.c for r in rows.select(text.carries(F.col("t"), F.col("f"), ["the"]).alias("c")).collect()]
    assert got == [True, False, True]
    assert normalize.normalize("A ﬁne\r\nline-\nbreak  here\n\n \nNext “para”\0") == "A fine linebreak here\n\nNext \"para\""
    fold = rows.select(normalize.casefolded(F.lit("Straße_A-b/c")).alias("x")).first().x
    assert fold == "strasse a b c"
    assert rows.select(normalize.normalized(F.lit(None).cast("string")).alias("x")).first().x is None
    ends = rows.select(spans.on_token_boundary(F.lit("ab cd"), F.lit(3), F.lit(5)).alias("a"), spans.on_token_boundary(F.lit("ab cd"), F.lit(1), F.lit(2)).alias("b")).first()
    assert (ends.a, ends.b) == (True, False)


def test_ancestors_of_a_cycle(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None)], "accession string, parent string")
    got = {tuple(r) for r in records.ancestors(rows, 4).collect()}
    assert got == {("a", "b", 1), ("b", "a", 1), ("c", "a", 1), ("c", "b", 2)}


def fastq_text(n):
    return "".join(f"@r{k} x\n{'ACGT'[k % 4] * (3 + k % 3)}\n+\n{'I' * (3 + k % 3)}\n" for k in range(n))


def test_fastq_source(spark, tmp_path):
    fastq.register(spark)
    (tmp_path / "a.fastq").write_text(fastq_text(5))
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(fastq_text(4))
    whole = (tmp_path / "b.fastq.gz").read_bytes()
    (tmp_path / "c.fastq.gz").write_bytes(whole + whole)  # members follow each other
    (tmp_path / "d.fastq.gz").write_bytes(whole[:-12])
    (tmp_path / "e.fastq").write_text(fastq_text(2) + "@cut\nAC")
    (tmp_path / "f.fastq.gz").write_bytes(b"\x1f\x8b\x08" + bytes(7) + b"\xff" * 40)
    (tmp_path / "g.fastq").write_text("")
    rows = spark.read.format("fastq").load(str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file[-len("a.fastq") :].lstrip("/") if r.file.endswith("fastq") else r.file[-len("b.fastq.gz") :], []).append(r)
    assert [len(by[k]) for k in ("a.fastq", "b.fastq.gz", "c.fastq.gz", "e.fastq", "g.fastq")] == [5, 4, 8, 2, 1]
    last = {k: (v[-1].truncated, v[-1].ok) for k, v in by.items()}
    assert last["a.fastq"] == last["b.fastq.gz"] == last["c.fastq.gz"] == last["g.fastq"] == (False, True)
    assert last["d.fastq.gz"] == (True, True) and last["e.fastq"] == (True, True) and last["f.fastq.gz"][1] is False
    assert by["a.fastq"][1].seq == "CCCC" and by["a.fastq"][1].name == "r1 x"
    some = spark.read.format("fastq").option("maxReads", 3).load(str(tmp_path / "a.fastq")).collect()
    assert len(some) == 3 and some[-1].truncated
    few = spark.read.format("fastq").option("maxBytes", 40).load(str(tmp_path / "[ab]*")).collect()
    assert {r.truncated for r in few if r.read_ix == 1} == {True}


def test_tables(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% x\n3 2 2\n1 1 5\n3 2 7\n")
    assert [tuple(r) for r in tables.read_matrix_market(spark, str(tmp_path / "m.mtx")).drop("file").orderBy("row").collect()] == [(0, 0, 5.0), (2, 1, 7.0)]
    (tmp_path / "a.gtf").write_text('#c\nchr1\tx\texon\t11\t20\t.\t+\t.\tgene_id "G1"; gene_name "N1"; gene_type "t";\n')
    assert tuple(tables.read_gtf(spark, str(tmp_path / "a.gtf")).first()) == ("chr1", "exon", 10, 20, "G1", "N1", "t")
    (tmp_path / "log").write_text("Reads | 12\nnothing\n  Rate |  3.5%\n")
    assert {tuple(r) for r in tables.read_key_values(spark, str(tmp_path / "log")).collect()} == {("Reads", "12"), ("Rate", "3.5%")}
    tables.write_tsv(spark.createDataFrame([("a\t b", 1)], "x string, y long"), str(tmp_path / "out"))
    assert "a b\t1" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def brute_tag(seq, anchor, trailing, start, umi, trail, cdna, drift, most):
    for at in range(start, start + drift + 1):
        motif = seq[at + trail : at + trail + len(trailing)]
        if seq[at:].startswith(anchor) and len(seq) > at + cdna and len(motif) == len(trailing) and sum(x != y for x, y in zip(motif, trailing, strict=True)) <= most:
            return at, seq[at + umi[0] : at + umi[0] + umi[1]]
    return None


def test_extract_tags(spark):
    rng = random.Random(3)
    g = {"anchor": "AC", "trailing": "GGG", "start": 1, "umi": (2, 4), "trail": 6, "cdna": 9, "drift": 5, "most": 1}
    seqs = ["", "AC", "AACTTTTGGG", "AACTTTTGGGA", "ACACACACACGGGT", None] + ["".join(rng.choices("ACG", k=rng.randrange(8, 24))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string").withColumn("file", F.lit("f"))
    tagged = reads.extract_tags(rows, **g)
    got = {r.id: r for r in tagged.collect()}
    assert len(got) == len(seqs) and sum(r.tagged for r in got.values()) > 50
    for k, seq in enumerate(seqs):
        want = brute_tag(seq, **g) if seq else None
        assert (got[k].tagged, got[k].start, got[k].umi) == ((True, *want) if want else (False, None, None)), seq
        assert got[k].seq == (seq[want[0] + 9 :] if want else seq)
    profile = reads.tag_profile(tagged, start=1).first()
    assert profile.reads == len(seqs) and profile.tagged == sum(r.tagged for r in got.values())
    assert profile.drifted == sum(r.tagged and r.start != 1 for r in got.values())
    assert reads.tag_profile(tagged.where("false"), start=1).count() == 0
