from __future__ import annotations

import itertools
import random

from tessera.operators import frames, signatures
from tessera.operators.frames import Element
from tessera.operators.signatures import Inputs, Test
from tessera.plans.frame_queries import BEAD


def brute(seq, layout):
    """mismatches, windows by walking every choice of lengths."""
    loose = [e for e in layout if e.least is not None and e.most is not None and e.least < e.most and not (e.bio and e.end is None)]
    best = None
    if seq is None or not any(e.sequence for e in layout):
        return None
    for sizes in itertools.product(*(range(e.least, e.most + 1) for e in loose)):
        chosen, at, windows, wrong, good = {e.name: n for e, n in zip(loose, sizes, strict=True)}, 0, {}, 0, True
        for e in layout:
            start = windows[e.after][0 if e.side == "start" else 1] + e.offset if e.after in windows else e.offset if e.after == "read" else at if e.start is None else e.start
            width = chosen.get(e.name, e.width())
            at = len(seq) if width is None else start + width
            good &= start >= 0 and at <= len(seq)
            windows[e.name] = (start, at)
            if e.sequence and good:
                off = sum(a != b for a, b in zip(seq[start:at], e.sequence, strict=False)) + abs(at - start - len(e.sequence))
                wrong += off
                good &= off <= (1 if e.mismatches is None else e.mismatches)
        if good and (best is None or wrong < best[0]):
            best = (wrong, windows)
    return best


LAYOUTS = [
    BEAD,
    [Element("a", least=0, most=2, after="read"), Element("l", sequence="GT", mismatches=0, after="a"), Element("b", least=1, most=3, after="l"), Element("m", sequence="CAC", after="b"), Element("u", least=2, most=2, after="m", offset=1)],
    [Element("l", start=2, end=6, sequence="ACGT"), Element("b", least=4, most=4), Element("back", least=2, most=2, after="l", side="start", offset=-2)],
    [Element("none", start=0, end=4)],
]


def test_frames_equal_brute_force(spark):
    rng = random.Random(1)
    for layout in LAYOUTS:
        reads = [None, "", "N" * 50]
        for _ in range(300):
            seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([5, 12, 31, 36, 40])))
            for e in layout:
                if e.sequence and rng.random() < 0.9:
                    at = rng.randrange(0, 24)
                    seq = seq[:at] + e.sequence + seq[at + len(e.sequence) :]
            reads.append(seq)
        for _ in range(60):
            cut = "".join(rng.choice("ACGT") for _ in range(rng.randrange(4)))
            reads.append(cut + "".join(e.sequence or "".join(rng.choice("ACGTN") for _ in range(e.width() or 5)) for e in layout if not e.varies))
        rows = spark.createDataFrame([(k, "f", r) for k, r in enumerate(reads)], "id long, file string, seq string")
        got = {r.id: r for r in frames.framed(rows, layout).collect()}
        found = 0
        for k, seq in enumerate(reads):
            want = brute(seq, layout)
            found += want is not None
            if want is None:
                assert got[k].phase is None and got[k].windows is None and got[k].mismatches is None
            else:
                assert (got[k].mismatches, {n: (w.start, w.end) for n, w in got[k].windows.items()}) == want
        assert found or layout == LAYOUTS[-1]
        for e in layout:
            cuts = sorted(r.bases for r in frames.element_bases(rows, layout, e.name).collect())
            assert cuts == sorted(c for s in reads if (w := brute(s, layout)) and (c := s[slice(*w[1][e.name])]))


def test_anchored_hits(spark):
    bead = lambda label, k: "ACG"[:k] + label + "GTGA" + "C" * 8 + "GACA" + "ACACAC" + "TTTTT"
    labels = ["AACCGGTT", "ACACACAC", "AGAGAGAG", "TTTTCCCC"]
    reads = [("f", bead(labels[k % 3], k % 4)) for k in range(24)] + [("f", bead("AACNGGTT", 1)), ("f", "ACGT" * 9), ("g", "ACGT"), ("h", bead("CCCCCCCC", 2)), ("r", bead("AACCGGTA", 0))]
    rows = spark.createDataFrame(reads, "file string, seq string")
    onlist = spark.createDataFrame([(x,) for x in [labels[0], labels[1], "TACCGGTT"]], "barcode string")
    got = {r.file: tuple(r)[1:] for r in frames.anchored_hit_rate(rows, BEAD, "label1", onlist, 8).collect()}
    assert got == {"f": ("forward", 24, 16), "g": ("forward", 0, 0), "h": ("forward", 0, 0), "r": ("revcomp", 1, 1)}
    ratio = {r.file: (r.n, r.ratio) for r in frames.anchored_distinct_ratio(rows, BEAD, "insert").collect()}
    assert ratio["f"] == (19, 3 / 19) and ratio["g"] == (0, None)  # a quarter of the inserts has no bases
    wide = frames.anchored_hit_rate(rows, BEAD, "label1", onlist, 9).where("file = 'f'").first()
    assert tuple(wide) == ("f", "forward", 0, 0)


def test_tables_of_tests_give_every_file_a_row(spark):
    reads = spark.createDataFrame([("f", "ACGTACGTAA"), ("f", "ACGTACGTCC"), ("n", "NNNNNNNNNN")], "file string, seq string")
    files = spark.createDataFrame([("f",), ("n",), ("none",)], "file string")
    onlist = spark.createDataFrame([("ACGT",)], "barcode string")
    tests = [Test("requires", "segment_length", "r", length=9, over_length=20), Test("supports", "onlist_hit_rate", "r", start=0, onlist="l", least=0.9, drift=0, orientation="forward"), Test("supports", "onlist_hit_rate", "r", onlist="x"),
             Test("supports", "distinct_ratio", "r", start=8, end=10, expect="high"), Test("supports", "distinct_ratio", "r", element="gone"), Test("excludes", "motif_present", "r", motif="GTAC", where="read_start")]
    rows = signatures.evaluate(tests, {"r": []}, Inputs(reads, files, onlists={"l": (onlist, 4)})).collect()
    got = {(r.test, r.file): (r.outcome, r.score, r.answerable, r.admits) for r in rows}
    assert len(rows) == len(tests) * 3
    assert got[0, "f"] == ("fail", 0.0, True, False) and got[0, "none"] == ("fail", 0.0, True, False)
    assert got[1, "f"] == ("pass", 1.0, True, True) and got[1, "n"] == got[1, "none"] == ("fail", 0.0, True, False)
    assert got[2, "f"] == got[2, "none"] == ("abstain", 0.0, True, False)
    assert got[3, "f"] == ("abstain", 1.0, True, False) and got[3, "none"] == ("abstain", 0.0, False, False)
    assert got[4, "f"] == ("abstain", 0.0, False, False)
    assert got[5, "f"] == ("fail", 0.0, True, False) and got[5, "n"] == ("abstain", 0.0, False, False)
    assert {(r.low, r.high) for r in rows if r.test == 0} == {(9, 20)}
