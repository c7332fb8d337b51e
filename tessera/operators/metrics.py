"""Per-sample metrics, rankings, admission, comparison and scores."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def knee_points(values: DataFrame, points: int = 200) -> DataFrame:
    """rank, value at up to ``points`` log-spaced ranks of the values (value) in falling order; of ``points`` values or fewer every rank.

    Ranks come from counts of equal values, so that equal values never meet in one task; the
    counts are ordered in ranges of values, each of which knows what lies above it."""
    counts = values.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    block = F.floor(F.log2(F.greatest(F.col("value").cast("double"), F.lit(1.0))) * 8)
    counts = counts.withColumn("block", block)
    sums = counts.groupBy("block").agg(F.sum("n").alias("held"))  # 8 rows for each doubling of values
    above = sums.select("block", F.coalesce(F.sum("held").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    upto = F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("value"))) + F.col("above")
    ranked = counts.join(F.broadcast(above), "block").withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n") + 1)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    wanted = total.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), "total").where("total > 0")
    rank = F.least(F.col("total"), F.greatest(F.lit(1), F.round(F.exp(F.ln("total") * F.col("k") / (points - 1)), 0).cast("long")))
    wanted = wanted.select(F.when(F.col("total") > points, rank).otherwise(F.col("k") + 1).alias("rank"), "total").where("rank <= total").select("rank").distinct()
    return ranked.join(F.broadcast(wanted), F.col("rank").between(F.col("from"), F.col("upto"))).select("rank", "value")


def admission(files: DataFrame, floor: int) -> DataFrame:
    """sample, reads, verdict of (sample, run, reads) file rows: reads are summed over runs, each
    run's being its least file's; a file of unknown depth makes its sample unmeasured."""
    runs = files.groupBy("sample", "run").agg(F.when(F.count_if(F.col("reads").isNull()) == 0, F.min("reads")).alias("reads"))
    by = runs.groupBy("sample").agg(F.when(F.count_if(F.col("reads").isNull()) == 0, F.sum("reads")).alias("reads"))
    return by.withColumn("verdict", F.when(F.col("reads").isNull(), "unmeasured").when(F.col("reads") >= floor, "admitted").otherwise("starved"))


def compare_counts(truth: DataFrame, observed: DataFrame) -> DataFrame:
    """Of (key, n) tables: exact, inflated, deflated, missed and spurious keys; recovered = sum of the lesser counts."""
    both = truth.select("key", F.col("n").alias("t")).join(observed.select("key", F.col("n").alias("o")), "key", "full")
    count = lambda c: F.count_if(c)
    t, o = F.col("t"), F.col("o")
    return both.agg(
        count(t == o).alias("exact"), count(o > t).alias("inflated"), count(o < t).alias("deflated"), count(o.isNull()).alias("missed"), count(t.isNull()).alias("spurious"),
        F.coalesce(F.sum(F.when(t.isNotNull() & o.isNotNull(), F.least(t, o))), F.lit(0)).alias("recovered"), F.coalesce(F.sum("t"), F.lit(0)).alias("truth"),
    )


def fit_line(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: least-squares slope and intercept of (x, y) and n; nulls below 3 points or without variance in x."""
    by = points.where("x is not null and y is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("x").alias("v"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    fits = (F.col("n") >= 3) & (F.col("v") > 0)
    return by.select(*keys, "n", F.when(fits, F.col("slope")).alias("slope"), F.when(fits, F.col("intercept")).alias("intercept"))


def alerts(findings: DataFrame, samples: DataFrame) -> DataFrame:
    """alert, n_samples, samples (sorted), systematic (fired on every one of two or more samples).

    The list is of a run's samples: thousands at most."""
    total = samples.select(F.col("sample")).distinct().agg(F.count("*").alias("total"))
    by = findings.groupBy("alert").agg(F.count_distinct("sample").alias("n_samples"), F.array_join(F.array_sort(F.collect_set(F.col("sample").cast("string"))), ",").alias("samples"))
    return by.join(F.broadcast(total)).select("alert", "n_samples", "samples", ((F.col("n_samples") == F.col("total")) & (F.col("total") > 1)).alias("systematic"))


def tie_band(candidates: DataFrame, keys: list[str], band: float = 0.02) -> DataFrame:
    """Candidates (name, value, rung) ranked by (-value, -rung, name); in_tie: within ``band`` of the key's best."""
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), F.desc("rung"), "name")
    best = F.max("value").over(Window.partitionBy(*keys))
    return candidates.withColumn("place", F.row_number().over(order)).withColumn("in_tie", F.round(best - F.col("value"), 9) <= band)


def escalated(candidates: DataFrame, keys: list[str], band: float = 0.02) -> DataFrame:
    """Per key: winner, or a question if several candidates tie and no single one of them has hit (boolean); options sorted."""
    tied = tie_band(candidates, keys, band).where("in_tie")
    by = tied.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.min_by("name", "place").alias("first"), F.min(F.when(F.col("hit"), F.col("name"))).alias("only"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("options"))
    winner = F.when(F.col("n") == 1, F.col("first")).when(F.col("hits") == 1, F.col("only"))
    return by.select(*keys, winner.alias("winner"), F.when(winner.isNull(), F.col("options")).alias("question"))


def weighted_score(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of (score, weight, answerable, gate_failed): forbidden, or the weighted mean over answerable tests (0 without)."""
    w = F.when(F.col("answerable"), F.col("weight"))
    by = tests.groupBy(*keys).agg(F.bool_or("gate_failed").alias("forbidden"), F.sum(w * F.col("score")).alias("s"), F.sum(w).alias("w"))
    return by.select(*keys, "forbidden", F.when(~F.col("forbidden"), F.round(F.coalesce(F.try_divide("s", "w"), F.lit(0.0)), 6)).alias("value"))


def chunked(rows: DataFrame, keys: list[str], order: list[Column], width: int) -> DataFrame:
    """``rows`` with chunk: fixed numbers of rows per key, in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("chunk", F.floor((place - 1) / width))


def greedy_batches(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """key, ordinal, batch of (key, ordinal, sha, chars): a batch closes before a row that would make it
    too many rows or characters, or that repeats a hash in it. The state follows a key's rows
    in order, so keys are the unit of work: they stand for question kinds, each with a bounded list."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        batch, size, chars, seen, out = 0, 0, 0, set(), []
        for sha, n in zip(pdf["sha"], pdf["chars"], strict=True):
            if size and (size >= most_rows or chars + n > most_chars or sha in seen):
                batch, size, chars, seen = batch + 1, 0, 0, set()
            size, chars = size + 1, chars + n
            seen.add(sha)
            out.append(batch)
        return pd.DataFrame({"key": pdf["key"], "ordinal": pdf["ordinal"], "batch": out})

    schema = f"key {rows.schema['key'].dataType.simpleString()}, ordinal long, batch long"
    return rows.groupBy("key").applyInPandas(run, schema)


def attribute_table(claims: DataFrame, preferred: list[str]) -> DataFrame:
    """A row per sample and a column per attribute, preferred ones first, the rest sorted; the least value where several differ."""
    seen = sorted(r["attribute"] for r in claims.select("attribute").distinct().collect())  # a curated vocabulary: column names
    columns = [a for a in preferred if a in seen] + [a for a in seen if a not in preferred]
    return claims.groupBy("sample").pivot("attribute", columns).agg(F.min("value"))
