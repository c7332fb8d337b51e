"""Where near-identical texts differ, what may be said of all of them at once, and what a record declares itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN, token_skeleton, token_values
from tessera.functions.normalize import normalized
from tessera.operators.spans import find_span, on_token_boundary


def token_spans(texts: DataFrame) -> DataFrame:
    """id, place (from 0), start, end, value of the tokens of (id, text), ids being unique; null texts have none."""
    parts = F.arrays_zip(F.split("text", TOKEN).alias("gap"), token_values(F.col("text")).alias("value"))
    rows = texts.where("text is not null").select("id", F.posexplode(parts).alias("place", "x")).select("id", "place", "x.gap", "x.value")
    end = F.sum(F.length("gap") + F.length("value")).over(Window.partitionBy("id").orderBy("place"))
    return rows.where("value is not null").select("id", "place", (end - F.length("value")).alias("start"), end.alias("end"), "value")


def _groups(texts: DataFrame) -> DataFrame:
    """id, exemplar (the least id), text of groups of two or more texts that differ in tokens alone, if at all."""
    rows = texts.where("text is not null").select("id", "text", F.sha2(token_skeleton(F.col("text")), 256).alias("skeleton"))
    by = rows.groupBy("skeleton").agg(F.min("id").alias("exemplar"), F.count("*").alias("n")).where("n > 1")
    return rows.join(by, "skeleton").select("id", "exemplar", "text")


def variant_spans(texts: DataFrame) -> DataFrame:
    """exemplar, place, start, end, value, n_values of (id, text): the exemplar's tokens at which its group's texts differ."""
    groups = _groups(texts)
    values = groups.select("exemplar", F.posexplode(token_values(F.col("text"))).alias("place", "token")).distinct()
    varying = values.groupBy("exemplar", "place").agg(F.count("*").alias("n_values")).where("n_values > 1")
    spans = token_spans(groups.where("id = exemplar").select("id", "text")).withColumnRenamed("id", "exemplar")
    return spans.join(varying, ["exemplar", "place"]).select("exemplar", "place", "start", "end", "value", "n_values")


def variant_texts(texts: DataFrame) -> DataFrame:
    """id, own of (id, text): what a member of a group but its exemplar says for itself.

    Its tokens at the varying places; neighbours keep what stands between them, others are
    parted by a blank line. Members equal to their exemplar in all of them are there too."""
    varying = variant_spans(texts).groupBy("exemplar").agg(F.array_sort(F.collect_list("place")).alias("places"))
    rows = _groups(texts).where("id <> exemplar").join(varying, "exemplar")
    rows = rows.select("id", "places", F.split("text", TOKEN).alias("gaps"), token_values(F.col("text")).alias("tokens"))
    joiner = lambda k, i: F.when(i == 0, "").when(F.get("places", i - 1) == k - 1, F.get("gaps", k)).otherwise("\n\n")
    return rows.select("id", F.array_join(F.transform("places", lambda k, i: F.concat(joiner(k, i), F.get("tokens", k))), "").alias("own"))


def fanned_claims(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """claim, doc, start, end, fanned of claims (claim, doc, quote, start, end, per_record) on texts (id, text).

    Every claim holds of its own document. One on a group's exemplar whose quote touches no
    varying token holds of all members: where it is meant per record, it has a row for each,
    with the place of its quote there; else one row stays, marked as fanned."""
    variants = variant_spans(texts).select(F.col("exemplar").alias("doc"), F.col("start").alias("from"), F.col("end").alias("to"))
    touched = claims.join(variants, "doc").where("from < end and start < to").select("claim").distinct()
    groups = _groups(texts)
    heads = groups.where("id = exemplar").select(F.col("exemplar").alias("doc"), F.lit(True).alias("head"))
    spoken = claims.where("start is not null and end is not null").join(touched, "claim", "left_anti").join(heads, "doc", "left_semi")
    members = groups.where("id <> exemplar").select(F.col("exemplar").alias("doc"), "id", "text")
    there = spoken.where("per_record").join(members, "doc").select("claim", "id", find_span(F.col("text"), F.col("quote")).alias("span"))
    others = there.where("span.start is not null").select("claim", F.col("id").alias("doc"), "span.start", "span.end", F.lit(True).alias("fanned"))
    reach = spoken.select("claim", F.lit(True).alias("fanned")).distinct()
    own = claims.join(reach, "claim", "left").select("claim", "doc", *(F.col(c).cast("int").alias(c) for c in ("start", "end")), F.coalesce("fanned", F.lit(False)).alias("fanned"))
    return own.union(others)


def declared_spans(texts: DataFrame, attributes: DataFrame) -> DataFrame:
    """id, start, end, attribute of (id, text) and (id, attribute, value): where a text holds a value of its own record's columns as whole tokens.

    Values are made canonical first, as the texts are. A span that several columns declare comes once, under the greatest of
    their names; empty and null values declare nothing. Ids of ``texts`` are unique."""
    wanted = attributes.select("id", "attribute", normalized(F.col("value")).alias("value")).where("value <> ''").distinct()
    # the text is parted in front of every occurrence, overlapping ones included
    ahead = F.concat(F.lit(r"(?=\Q"), F.replace("value", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    rows = texts.join(wanted, "id").where(F.contains("text", F.col("value")))
    pieces = rows.select("id", "attribute", "value", F.posexplode(F.split("text", ahead)).alias("k", "piece"))
    pieces = pieces.withColumn("n", F.length("piece")).drop("piece")
    order = Window.partitionBy("id", "attribute", "value").orderBy("k")
    places = pieces.select("id", "attribute", "value", (F.sum("n").over(order) - F.col("n")).alias("start"))
    spans = places.join(texts, "id").withColumn("end", F.col("start") + F.length("value"))
    spans = spans.where(F.substring("text", F.col("start").cast("int") + 1, F.length("value")) == F.col("value"))
    spans = spans.where(on_token_boundary(F.col("text"), F.col("start").cast("int"), F.col("end").cast("int")))
    return spans.groupBy("id", "start", "end").agg(F.max("attribute").alias("attribute"))
