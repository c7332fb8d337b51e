"""Pairing with refusal, integrity checks, gates in order, and agreement over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Files (keys, path) of two mates paired by keys, in order of path inside them: keys, place, path_1, path_2, refused.

    A file without a partner refuses its key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    one = first.select(*keys, F.col("path").alias("path_1")).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("path_1")))
    two = second.select(*keys, "path", place.alias("place")).withColumnRenamed("path", "path_2")
    both = one.join(two, [*keys, "place"], "full")
    odd = F.bool_or(F.col("path_1").isNull() | F.col("path_2").isNull()).over(Window.partitionBy(*keys))
    return both.select(*keys, "place", "path_1", "path_2", odd.alias("refused"))


def routed(records: DataFrame) -> DataFrame:
    """template, component of records (template, reference): the suffix after the last underscore; null and
    spanning = true for a template whose records lie in several components."""
    part = F.substring_index("reference", "_", -1)
    by = records.groupBy("template").agg(F.min(part).alias("lo"), F.max(part).alias("hi"), F.count("*").alias("records"))
    return by.select("template", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("component"), (F.col("lo") != F.col("hi")).alias("spanning"), "records")


def broken_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str) -> DataFrame:
    """check, value, n: keys of a table that its parent lacks; null keys are no references."""
    left = child.where(F.col(key).isNotNull()).select(F.col(key).alias("value"))
    lost = left.join(parent.select(F.col(parent_key).alias("value")).distinct(), "value", "left_anti")
    return lost.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), F.col("value").cast("string").alias("value"), "n")


def first_gate(rows: DataFrame, key: str, gates: list[tuple[str, str]]) -> DataFrame:
    """key, gate: the first of (name, condition) that holds; passed if none does; a null condition does not hold."""
    out = None
    for name, condition in gates:
        hit = F.coalesce(F.expr(condition), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return rows.select(key, out.otherwise("passed").alias("gate"))


def run_agreement(runs: DataFrame) -> DataFrame:
    """sample, n_runs, outcome of (sample, run, winner): agreed, inherited (runs without a winner follow
    the others), disagreed (several winners; no majority counts) or unresolved."""
    by = runs.groupBy("sample").agg(F.count("*").alias("n_runs"), F.count("winner").alias("n_won"), F.min("winner").alias("lo"), F.max("winner").alias("hi"))
    outcome = F.when(F.col("n_won") == 0, "unresolved").when(F.col("lo") != F.col("hi"), "disagreed").when(F.col("n_won") < F.col("n_runs"), "inherited").otherwise("agreed")
    return by.select("sample", "n_runs", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("winner"), outcome.alias("outcome"))


def common_reason(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most common reason per key of (keys, reason, ordinal); the one seen first wins ties."""
    by = rows.groupBy(*keys, "reason").agg(F.count("*").alias("n"), F.min("ordinal").alias("seen"))
    return by.groupBy(*keys).agg(F.max_by("reason", F.struct("n", -F.col("seen"))).alias("reason"), F.sum("n").alias("n"))


def graded_cases(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case, grade of expected (case, outcome, value) and actual (case, outcome, value): correct, wrong_value,
    wrong_decision (decided, though it should not have), over_cautious, wrong_outcome or not_run."""
    rows = expected.join(actual.select("case", F.col("outcome").alias("got"), F.col("value").alias("got_value")), "case", "left")
    e, g = F.col("outcome"), F.col("got")
    grade = (
        F.when(g.isNull(), "not_run").when((e == g) & ((e != "decide") | F.col("value").eqNullSafe(F.col("got_value"))), "correct").when(e == g, "wrong_value")
        .when(g == "decide", "wrong_decision").when(e == "decide", "over_cautious").otherwise("wrong_outcome")
    )
    return rows.select("case", grade.alias("grade"))


def unpivoted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, metric, value: a row per named column, null values left out."""
    return rows.unpivot([key], columns, "metric", "value").where("value is not null")
