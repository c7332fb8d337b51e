"""Variant spans, fanned claims, declared spans and metric display over small planted rows."""

from __future__ import annotations

from tessera.operators import bundles, variants


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


TEXTS = [(1, "age: 3 WT x"), (2, "age: 30 KO x"), (3, "other"), (4, None), (5, "")]


def test_variants_of_a_group(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    assert rows(variants.variant_spans(texts), "exemplar", "place", "start", "end", "value", "n_values") == [(1, 1, 5, 6, "3", 2), (1, 2, 7, 9, "WT", 2)]
    assert rows(variants.variant_texts(texts), "id", "own") == [(2, "30 KO")]


def test_claims_fan_only_outside_variants(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    claims = [(10, 1, "x", 10, 11, True), (11, 1, "WT", 7, 9, True), (12, 1, "age", 0, 3, False), (13, 2, "x", 11, 12, True), (14, 3, "other", 0, 5, True)]
    got = variants.fanned_claims(spark.createDataFrame(claims, "claim long, doc long, quote string, start int, end int, per_record boolean"), texts)
    assert rows(got, "claim", "doc", "start", "end", "fanned") == [(10, 1, 10, 11, True), (10, 2, 11, 12, True), (11, 1, 7, 9, False), (12, 1, 0, 3, True), (13, 2, 11, 12, False), (14, 3, 0, 5, False)]


def test_declared_spans_are_whole_tokens(spark):
    texts = spark.createDataFrame([(1, "CD4 in CD45, CD4; a.b aXb a\\Eb"), (2, None)], "id long, text string")
    columns = [(1, "marker", "CD4"), (1, "alias", "CD4"), (1, "dot", "a.b"), (1, "odd", "a\\Eb"), (1, "none", ""), (1, "null", None), (1, "curly", "in\u00a0CD45"), (2, "x", "y")]
    got = variants.declared_spans(texts, spark.createDataFrame(columns, "id long, attribute string, value string"))
    assert rows(got, "start", "end", "attribute") == [(0, 3, "marker"), (4, 11, "curly"), (13, 16, "marker"), (18, 21, "dot"), (26, 30, "odd")]


def test_displays_round_as_printf(spark):
    values = [0.25, 0.35, 0.05, -0.04, 2.5, 999.5, 1250.0, 1e12, 0.0, 123456789.0]
    bars = spark.createDataFrame([("r", "ratio", None, None, True)], "metric string, kind string, ok double, warn double, higher boolean")
    got = bundles.graded_metrics(spark.createDataFrame([(k, "r", v) for k, v in enumerate(values)], "sample int, metric string, value double"), bars)
    assert rows(got, "sample", "display", "level") == [(k, f"{v:.1f}", "none") for k, v in enumerate(values)]


def test_empty_tables(spark):
    texts = spark.createDataFrame([], "id long, text string")
    assert variants.variant_spans(texts).count() == 0
    assert bundles.worst_outcomes(spark.createDataFrame([], "case long, outcome string")).count() == 0
