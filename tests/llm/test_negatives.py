from __future__ import annotations

import math
import random

import duckdb
import numpy as np

from tessera.llm import negatives
from tessera.llm.negatives import ORACLE_SQL, mine_negatives, planes, within

SCHEMA = "vec_id long, embedding array<float>, label int, block string, scores int"


def brute(rows, shift=(7, 10)):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, shift[1])) if i % shift[0] == 0 else label
        row = (label, [math.floor(256 * x) for x in v])
        seen[i] = min(seen.get(i, row), row)
    out = []
    for a, (label, v) in seen.items():
        if a % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for i, (other, w) in seen.items() if i != a)
            for ps, p, _ in [x for x in scored if x[2]][:5]:
                fits = [x for x in scored if not x[2] and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:3]
                out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, dim=16, labels=4, steps=64):
    """Clustered vectors with many ties: components are multiples of 1/steps."""
    rng = random.Random(seed)
    centre = [[rng.uniform(-0.5, 0.5) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = 0 if rng.random() < 0.4 else rng.randrange(labels)
        rows.append((i, [round(c * steps + rng.uniform(-9, 9)) / steps for c in centre[rng.choice([label, rng.randrange(labels)])]], label))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", 1) for r in rows], SCHEMA).repartition(3)


def mined(spark, rows, **more):
    return sorted(map(tuple, mine_negatives(frame(spark, rows), shift=(7, 10), **more).collect()))


def test_equals_brute_force_and_sql(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "TILE", 3)
    monkeypatch.setattr(negatives, "SPARSE", 3)
    rows = vectors(1, 700)
    got = mined(spark, rows)
    assert got and got == brute(rows)
    embeddings = frame(spark, rows).toPandas()  # noqa: F841  DuckDB reads it by its name
    embeddings["vec_id"] = embeddings["vec_id"].astype("int64")
    assert sorted(duckdb.sql(ORACLE_SQL).fetchall()) == got


def test_awkward_rows(spark):
    rows = vectors(2, 120)
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[0][1], 1), (200, None, 1), (250, rows[3][1], None), (300, [nan] * 16, 1), (350, [inf] + [0.0] * 15, 1), (400, [None] + [0.5] * 15, 1)]
    rows += [(450, [0.5, 0.5], 1), (500, [], 0), (550, [0.0] * 16, 2), rows[50], (50, rows[3][1], 3), (-50, rows[50][1], -1), (-7, rows[50][1], -3)]
    rows += [(600 + k, rows[0][1], k % 4) for k in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_one_label_none_and_empty(spark):
    assert mined(spark, [(i, v, 0) for i, v, _ in vectors(3, 60) if i % 7]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    assert mine_negatives(frame(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 3000 for x in v], label) for i, v, label in vectors(4, 130)]
    got = mined(spark, rows)
    assert got and got == brute(rows)


def test_intervals_keep_exactly_the_scores_within():
    rng = np.random.default_rng(5)
    q, a = rng.integers(-300, 300, (200, 24)), rng.integers(-300, 300, (30, 24))
    want = q @ a.T
    low, high = np.quantile(want, 0.9, axis=0).round(), np.quantile(want, 0.97, axis=0).round()
    live = rng.random(want.shape) < 0.8
    row, col, score = within(planes(q, np.float64), a, low, high, live)
    there = live & (want >= low) & (want <= high)
    assert sorted(zip(row.tolist(), col.tolist(), score.tolist(), strict=True)) == [(r, c, want[r, c]) for r, c in np.argwhere(there).tolist()]


def test_no_table_goes_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    ran = lambda: {store.executionsList().apply(k).executionId(): store.executionsList().apply(k).physicalPlanDescription() for k in range(store.executionsList().size())}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = ran()
    assert mined(spark, vectors(6, 200))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [plan for k, plan in ran().items() if k not in before]
    assert sum("SortMergeJoin" in plan for plan in plans) >= 2
    assert not [plan for plan in plans if "BroadcastExchange" in plan]
