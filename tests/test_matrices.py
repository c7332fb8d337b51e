from __future__ import annotations

import random
from collections import defaultdict

from tessera.operators import matrices
from tessera.sources import tables

ENTRIES, NAMES = "layer string, sample string, row long, column long, value double", "layer string, sample string, at long, name string"


def test_stacks_align_features_and_cells(spark):
    rng = random.Random(1)
    entries, features, barcodes, want = [], [], [], defaultdict(float)
    for layer, sample in (("exon", "a"), ("intron", "a"), ("exon", "b"), ("empty", "a")):
        own = rng.sample([f"g{k}" for k in range(9)], 6)
        cells = [f"c{k}" for k in rng.sample(range(7), 5)]
        features += [(layer, sample, k, g) for k, g in enumerate(own)]
        barcodes += [(layer, sample, k, c) for k, c in enumerate(cells)]
        for _ in range(0 if layer == "empty" else 25):
            r, c, v = rng.randrange(6), rng.randrange(5), float(rng.randrange(3))
            entries.append((layer, sample, r, c, v))
            if v:
                want[layer, sample, cells[c], own[r]] += v
    got, axis, cells = matrices.stack(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(features, NAMES), spark.createDataFrame(barcodes, NAMES))
    names = {r.at: r.name for r in axis.collect()}
    assert names == dict(enumerate(sorted({f[3] for f in features})))
    where = {r.at: (r.sample, r.name) for r in cells.collect()}
    assert where == dict(enumerate(sorted({(s, c) for _, s, c, _ in want})))
    assert {(r.layer, *where[r.cell], names[r.feature]): r.value for r in got.collect()} == dict(want)
    odd = {(r.layer, r.sample) for r in matrices.differing_axes(spark.createDataFrame(features, NAMES), "exon").collect()}
    assert odd == {("intron", "a"), ("empty", "a")}
    stray = matrices.stray_entries(spark.createDataFrame([*entries, ("exon", "a", 6, 0, 1.0), ("exon", "a", 0, 5, 1.0)], ENTRIES), spark.createDataFrame(features, NAMES), spark.createDataFrame(barcodes, NAMES))
    assert [tuple(r) for r in stray.collect()] == [("exon", "a", 2)]


def test_files_have_sizes_of_their_own(spark, tmp_path):
    one, two = [(0, 0, 5), (2, 1, 7)], [(1, 0, 3)]
    for name, rows in (("one.mtx", one), ("two.mtx", two)):
        tables.write_matrix_market(spark.createDataFrame(rows, "row long, column long, value long").repartition(3), str(tmp_path / name), 3, 2)
    (tmp_path / "plain.mtx").mkdir()
    (tmp_path / "plain.mtx" / "m.mtx").write_text("%%MatrixMarket\n% more\n\n4 4 1\n4 4 9\n")
    got = {(r.file.split("/")[-2].split(".")[0], r.row, r.column, r.value) for r in tables.read_matrix_market(spark, str(tmp_path / "*.mtx")).collect()}
    assert got == {("one", r, c, float(v)) for r, c, v in one} | {("two", 1, 0, 3.0), ("plain", 3, 3, 9.0)}
    (tmp_path / "features.tsv").write_text("g1\tname 1\tGene\n\ng0\n")
    assert [(r.at, r.name, r.fields) for r in tables.read_names(spark, str(tmp_path / "features.tsv")).collect()] == [(0, "g1", ["name 1", "Gene"]), (1, "g0", [])]
