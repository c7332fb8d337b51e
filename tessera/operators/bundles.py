"""Metrics of samples as graded, readable rows; deliverables, bounds and outcomes of whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import grade, one_decimal, value_kind

#: Outcomes of trials from the worst to the best.
OUTCOMES = ["false_accept", "false_refuse", "mis_triage", "wrong_reason", "over_ask", "correct"]


def whole(value: Column) -> Column:
    """A number without places, thousands parted by commas; ties go to the even number."""
    return F.format_number(F.rint(value), 0)


def shortened(value: Column) -> Column:
    """A number in thousands, millions or billions to one place; below, without places."""
    out = None
    for unit, sign in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        hit, text = F.abs(value) >= unit, F.concat(one_decimal(value / unit), F.lit(sign))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(whole(value))


def graded_metrics(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """sample, metric, value, display, level of rows (sample, metric, value) and bars (metric, kind, ok, warn, higher).

    kind: fraction (shown as a percentage), count, exact or ratio. Null values and metrics
    without a bar's row are left out; a missing bar grades as none."""
    value = F.col("value").cast("double")
    display = (
        F.when(F.col("kind") == "fraction", F.concat(one_decimal(value * 100), F.lit("%"))).when(F.col("kind") == "count", shortened(value))
        .when(F.col("kind") == "exact", whole(value)).otherwise(one_decimal(value))
    )
    ok, warn = F.col("ok"), F.col("warn")
    level = F.when(F.col("higher"), grade(value, ok, warn)).otherwise(grade(value, ok, warn, higher_is_better=False))
    return rows.where("value is not null").join(bars, "metric").select("sample", "metric", value.alias("value"), display.alias("display"), level.alias("level"))


def sample_bundles(metrics: DataFrame) -> DataFrame:
    """sample, ordinal, metric, value of metrics (sample, part, component, metric, value): all of a sample's parts as one list.

    Parts come in their order, metrics of a component under its name and in order of names;
    a sample that only some parts know has those."""
    name = F.when(F.col("component").isNull(), F.col("metric")).otherwise(F.concat_ws("_", "metric", "component"))
    rows = metrics.select("sample", "part", name.alias("metric"), "value")
    entry = F.struct("part", "metric", "value")
    by = rows.groupBy("sample").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # a sample's few dozen metrics
    return by.select("sample", F.posexplode("entries").alias("ordinal", "e")).select("sample", "ordinal", "e.metric", "e.value")


def worst_outcomes(trials: DataFrame) -> DataFrame:
    """case, n_trials, outcome of (case, outcome): the worst that a case met; outcomes not in the list count for nothing."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    by = trials.groupBy("case").agg(F.count("*").alias("n_trials"), F.min(F.when(rank > 0, rank)).cast("int").alias("rank"))
    return by.select("case", "n_trials", F.get(F.array(*map(F.lit, OUTCOMES)), F.col("rank") - 1).alias("outcome"))


def missing_deliverables(demanded: DataFrame, components: DataFrame, present: DataFrame) -> DataFrame:
    """dataset, name of demanded (dataset, pattern), components (dataset, component), present (dataset, name): what is not there.

    A pattern with ``{component}`` stands for a name per component, and for itself if its
    dataset has none."""
    parts = components.distinct().withColumn("part", F.lit(True))
    plain = demanded.where(~F.contains("pattern", F.lit("{component}"))).select("dataset", F.col("pattern").alias("name"))
    each = demanded.where(F.contains("pattern", F.lit("{component}"))).join(parts, "dataset", "left")
    each = each.select("dataset", F.when(F.col("part"), F.replace("pattern", F.lit("{component}"), F.col("component"))).otherwise(F.col("pattern")).alias("name"))
    return plain.union(each).distinct().join(present, ["dataset", "name"], "left_anti")


def loosest_caps(parts: DataFrame, caps: DataFrame) -> DataFrame:
    """assembly, cap of parts (assembly, component) and caps (component, cap): the largest cap, null if any component has none."""
    rows = parts.join(caps, "component", "left")
    return rows.groupBy("assembly").agg(F.when(F.count_if(F.col("cap").isNull()) == 0, F.max("cap")).alias("cap"))


def preferred_attributes(records: DataFrame, attributes: DataFrame, better: DataFrame, level: str = "sample") -> DataFrame:
    """accession, name, value: the attributes (accession, name, value) of records (accession, level), replaced as a whole where a record of ``level`` has better ones."""
    known = better.select("accession").distinct()
    taken = records.where(F.col("level") == level).select("accession").distinct().join(known, "accession", "left_semi")
    own = attributes.join(records.select("accession").distinct(), "accession", "left_semi").join(taken, "accession", "left_anti")
    return own.select("accession", "name", "value").union(better.join(taken, "accession", "left_semi").select("accession", "name", "value"))


def dropped_reads(runs: DataFrame, statistics: DataFrame, slack: float = 1.0) -> DataFrame:
    """run, spot_length, published, missing of runs (run, read_count, base_count) and statistics (run, spot_length):
    runs whose published bases a spot fall short by more than ``slack``. Missing or zero counts accuse nobody."""
    published = F.col("base_count") / F.col("read_count")
    rows = runs.where("read_count > 0 and base_count > 0").join(statistics, "run").where(F.col("spot_length") > published + slack)
    return rows.select("run", "spot_length", F.round(published, 2).alias("published"), F.round(F.col("spot_length") - published, 2).alias("missing"))


#: Accessions that name a study of its own.
STUDY = r"\b(?:GSE\d+|PRJ[A-Z]{2}\d+)\b"
#: Words that establish no strain on their own.
STRAIN_STOP = ["wild", "type", "wildtype", "strain", "control", "mutant", "line", "the", "and"]


def study_signals(texts: DataFrame, own: DataFrame) -> DataFrame:
    """doc, signal of texts (doc, text) and own (accession): match if a text names a study of ours, mismatch if only others, abstain if none."""
    named = texts.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(STUDY), 0))).alias("accession"))
    hits = named.join(own.select("accession", F.lit(1).alias("ours")).distinct(), "accession", "left").groupBy("doc").agg(F.count("ours").alias("ours"))
    signal = F.when(F.col("ours").isNull(), "abstain").when(F.col("ours") > 0, "match").otherwise("mismatch")
    return texts.select("doc").distinct().join(hits, "doc", "left").select("doc", signal.alias("signal"))


def strain_signals(asserted: DataFrame, recorded: DataFrame) -> DataFrame:
    """dataset, signal of asserted and recorded (dataset, value): match if they share a significant word, mismatch if both have some and share none, else abstain."""

    def words(rows: DataFrame) -> DataFrame:
        found = F.filter(F.split(F.lower("value"), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(STRAIN_STOP))
        return rows.select("dataset", F.explode(found).alias("word")).distinct()

    both = words(asserted).withColumn("a", F.lit(1)).join(words(recorded).withColumn("r", F.lit(1)), ["dataset", "word"], "full")
    by = both.groupBy("dataset").agg(F.count("a").alias("a"), F.count("r").alias("r"), F.count(F.col("a") + F.col("r")).alias("shared"))
    rows = asserted.select("dataset").union(recorded.select("dataset")).distinct().join(by, "dataset", "left")
    none = (F.coalesce("a", F.lit(0)) == 0) | (F.coalesce("r", F.lit(0)) == 0)
    return rows.select("dataset", F.when(none, "abstain").when(F.col("shared") > 0, "match").otherwise("mismatch").alias("signal"))


def name_value_lines(lines: DataFrame) -> DataFrame:
    """id, name, value, kind of (id, line): a line's first word and the rest, white space as one space; fewer than two words give nothing.

    A value of several words is a str whatever it looks like."""
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("id", words.alias("w")).where("size(w) >= 2")
    value = F.array_join(F.slice("w", 2, F.size("w")), " ")
    return rows.select("id", F.get("w", F.lit(0)).alias("name"), value.alias("value"), F.when(F.size("w") == 2, value_kind(value)).otherwise("str").alias("kind"))
