"""Trees with faults, introns, active sets and run inventories on small tables."""

from __future__ import annotations

from tessera.operators import intervals, records, trees
from tessera.sources import tables


def test_faults_of_trees(spark):
    rows = [("a", None, True, False), ("b", "a", False, True), ("c", "c", False, True), ("d", "x", False, True), ("e", "f", True, True), ("f", "e", True, True), ("g", None, True, True), ("h", "b", False, False)]
    nodes = spark.createDataFrame(rows, "node string, parent string, family boolean, runnable boolean")
    found = {tuple(r) for r in trees.tree_findings(nodes).collect()}
    assert found == {("b", "leaf_with_children"), ("c", "self_parent"), ("c", "leaf_with_children"), ("d", "unknown_parent"), ("e", "cycle"), ("f", "cycle"), ("g", "childless_family")}
    root = {r.node: (r.root, r.depth) for r in trees.roots(nodes).collect()}
    assert root == {"a": ("a", 0), "b": ("a", 1), "h": ("a", 2), "g": ("g", 0), "c": (None, None), "d": (None, None), "e": (None, None), "f": (None, None)}
    assert trees.tree_findings(nodes.limit(0)).collect() == []
    pairs = spark.createDataFrame([("b", "h"), ("b", "g"), ("c", "d")], "a string, b string")
    assert {(r.a, r.b, r.same) for r in trees.same_family(pairs, nodes).collect()} == {("b", "h", True), ("b", "g", False), ("c", "d", False)}


def test_ancestors_up_to_the_root(spark):
    rows = spark.createDataFrame([(str(k), str(k + 1) if k < 9 else None) for k in range(10)], "accession string, parent string")
    assert records.ancestors(rows).where("accession = '0'").count() == 9
    assert records.ancestors(rows, 4).where("accession = '0'").count() == 4


def test_introns_and_sets(spark):
    exons = [("c", 0, 10, "g"), ("c", 100, 120, "g"), ("c", 400, 420, "g"), ("c", 200, 210, "h"), ("c", 500, 510, "i"), ("c", 900, 910, "i"), ("c", 905, 990, "i"), ("d", 5, 5, "j")]
    table = spark.createDataFrame(exons, "contig string, start long, end long, gene string")
    assert sorted(tuple(r) for r in intervals.clean_introns(table, 50, 100).collect()) == [("c", "g", 10, 100), ("c", "i", 510, 900)]
    spans = spark.createDataFrame([("c", 10, 40, "g0"), ("c", 10, 40, "g1"), ("c", 10, 25, "g2"), ("c", 25, 60, "g3"), ("c", 40, 40, "g4"), ("c", 70, 90, "g5")], "contig string, start long, end long, gene string")
    assert sorted(tuple(r)[1:] for r in intervals.active_sets(spans, 16).collect()) == [(10, 25, "g0,g1,g2"), (25, 40, "g0,g1,g3"), (40, 60, "g3"), (70, 90, "g5")]


def test_coverage_over_blocks(spark):
    import random

    rng = random.Random(5)
    spans = [("c", s := rng.randrange(300), s + rng.randrange(80)) for _ in range(60)]
    rows = spark.createDataFrame(spans, "contig string, start long, end long")
    depth = {}
    for r in intervals.coverage_steps(rows, 16).collect():
        depth.update({k: r.depth for k in range(r.start, r.end)})
    assert depth == {k: n for k in range(400) if (n := sum(s <= k < e for _, s, e in spans))}


def test_file_report(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("run_accession\tfastq_ftp\tfastq_md5\tfastq_bytes\nR1\ta/1;a/2\tx;y\t10;z\n\nR2\ta/3\nR3\ta/4\tw\t1;2\n")
    rows = tables.read_file_report(spark, str(tmp_path / "r.tsv"))
    assert rows.count() == 3 and rows.where("run_accession = 'R2'").first().fastq_md5 is None
    got = sorted(tuple(r) for r in tables.report_files(rows).collect())
    assert got == [("R1", "https://a/1", "x", 10), ("R1", "https://a/2", "y", 0), ("R3", "https://a/4", "w", 0)]
