"""Record hierarchies, joins that refuse, precedence, near-identical texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN, token_skeleton, token_values
from tessera.scratch import stored

#: How much each basis of a value weighs.
BASIS_RANK = {"observed": 3, "user_confirmed": 2, "asserted": 1, "inferred": 0}


def ancestors(records: DataFrame, depth: int | None = None) -> DataFrame:
    """accession, ancestor, distance of (accession, parent) rows, up to the roots or ``depth`` levels above; cycles end where they meet themselves.

    A level is a join with the table itself, until a level brings nothing new."""
    edges = stored(records.where("parent is not null").select("accession", F.col("parent").alias("ancestor")).distinct(), "edges")
    up = edges.select(F.col("accession").alias("ancestor"), F.col("ancestor").alias("above"))
    level, out, k = edges.withColumn("distance", F.lit(1)), None, 1
    while True:
        out = level if out is None else out.union(level)
        k += 1
        if depth is not None and k > depth:
            break
        level = level.join(up, "ancestor").select("accession", F.col("above").alias("ancestor")).distinct()
        # a table a level: later plans do not hold the earlier joins
        level = stored(level.join(out.select("accession", "ancestor"), ["accession", "ancestor"], "left_anti").withColumn("distance", F.lit(k)), "level")
        if level.isEmpty():
            break
    return out.where("accession <> ancestor")


def ancestor_at(records: DataFrame, level: str, depth: int | None = None) -> DataFrame:
    """accession, its nearest ancestor at a level (itself, if it is there); null without one."""
    at = records.where(F.col("level") == level).select(F.col("accession").alias("ancestor"))
    up = ancestors(records, depth).union(records.select("accession", F.col("accession").alias("ancestor"), F.lit(0).alias("distance")))
    found = up.join(at, "ancestor").groupBy("accession").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("ancestor"))
    return records.select("accession").join(found, "accession", "left")


def files_to_samples(files: DataFrame, runs: DataFrame) -> DataFrame:
    """file, run, sample, refused: files (file, accession) to runs (run, filename, sample) by accession, else by file name.

    One file that nothing claims refuses the whole set: refused is true in every row."""
    by_run = runs.select(F.col("run").alias("accession"), F.col("run").alias("run1"), F.col("sample").alias("sample1"))
    by_name = runs.where("filename is not null").groupBy(F.col("filename").alias("file")).agg(F.min_by(F.struct("run", "sample"), "run").alias("named"))
    rows = files.join(by_run, "accession", "left").join(by_name, "file", "left")
    rows = rows.select("file", F.coalesce("run1", "named.run").alias("run"), F.coalesce("sample1", "named.sample").alias("sample"))
    refusals = rows.agg(F.coalesce(F.bool_or(F.col("run").isNull()), F.lit(False)).alias("refused"))  # one row
    return rows.join(F.broadcast(refusals))


def decided_values(claims: DataFrame) -> DataFrame:
    """One value per (subject, attribute) of claims (subject, attribute, value, basis, source, declared).

    The highest basis counts; inside it a source that declared a value silences its own
    undeclared readings. One value left is it; several give null and the outcome conflict."""
    rank = F.create_map(*(F.lit(x) for pair in BASIS_RANK.items() for x in pair))
    rows = claims.withColumn("rank", F.element_at(rank, F.col("basis")))
    key = Window.partitionBy("subject", "attribute")
    rows = rows.withColumn("top", F.max("rank").over(key)).where("rank = top")
    spoken = F.bool_or("declared").over(Window.partitionBy("subject", "attribute", "source"))
    rows = rows.withColumn("spoken", spoken).where("declared or not spoken")
    by = rows.groupBy("subject", "attribute").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"), F.first("basis").alias("basis"))
    return by.select("subject", "attribute", F.when(F.col("n") == 1, F.col("value")).alias("value"), "basis", F.when(F.col("n") == 1, "decided").otherwise("conflict").alias("outcome"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order. Ties in it must not matter."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def skeleton_groups(texts: DataFrame) -> DataFrame:
    """Near-identical texts: groups of two or more (id, text) rows that differ in tokens alone, and in at least one.

    id, exemplar (the least id of the group), members, varying (places of tokens with more
    than one value) and own (this text's tokens there)."""
    rows = texts.where("text is not null").select("id", F.sha2(token_skeleton(F.col("text")), 256).alias("skeleton"), token_values(F.col("text")).alias("tokens"))
    groups = rows.groupBy("skeleton").agg(F.count("*").alias("members"), F.min("id").alias("exemplar")).where("members > 1")
    rows = rows.join(groups, "skeleton")
    places = rows.select("skeleton", F.posexplode("tokens").alias("place", "token")).groupBy("skeleton", "place").agg(F.min("token").alias("lo"), F.max("token").alias("hi")).where("lo <> hi")
    varying = places.groupBy("skeleton").agg(F.array_sort(F.collect_list("place")).alias("varying"))
    out = rows.join(varying, "skeleton")
    own = F.array_join(F.transform("varying", lambda k: F.get("tokens", k)), " ")
    return out.select("id", "exemplar", "members", F.array_join(F.transform("varying", lambda k: k.cast("string")), ",").alias("varying"), own.alias("own"))


def shingles(texts: DataFrame, width: int) -> DataFrame:
    """id, shingle (distinct): hashes of all runs of ``width`` lower-case tokens."""
    words = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), 0), F.lower)
    rows = texts.where("text is not null").select("id", words.alias("w")).where(F.size("w") >= width)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda k: F.sha1(F.array_join(F.slice("w", k, F.lit(width)), " ")))
    return rows.select("id", F.explode(F.array_distinct(runs)).alias("shingle"))


def shared_shingles(texts: DataFrame, others: DataFrame, width: int) -> DataFrame:
    """Per text that shares one: distinct shingles in common with any of the others, and the rate of its own."""
    known = shingles(others, width).select("shingle").distinct().withColumn("known", F.lit(1))
    by = shingles(texts, width).join(known, "shingle", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("known").alias("shared"))
    return by.where("shared > 0").withColumn("rate", F.col("shared") / F.col("n"))


def quote_residue(texts: DataFrame, least: int = 4) -> DataFrame:
    """batch, n_documents, n_spans, n_ambiguous of (batch, id, text): of the runs of ``least`` tokens that a batch's texts hold, how many are in more than one of them.

    A run is the text from its first token to its last, separators included; a text's equal
    runs count once. The runs are compared by 64-bit hashes."""
    starts = r"[^\p{L}\p{N}_]+"
    token, gap = F.filter(F.split("text", starts), lambda x: x != ""), F.regexp_extract_all("text", F.lit(starts), 0)
    # gaps between tokens only: one before the first token is no gap
    gap = F.when(F.col("text").rlike(rf"^{starts}"), F.slice(gap, F.lit(2), F.size(gap))).otherwise(gap)
    rows = texts.select("batch", "id", token.alias("w"), gap.alias("g"))
    pieces = F.zip_with("w", "g", lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    rows = rows.select("batch", "id", "w", pieces.alias("p"))
    run = lambda k: F.xxhash64(F.concat(F.array_join(F.slice("p", k, F.lit(least - 1)), ""), F.get("w", k + (least - 2))))
    runs = F.when(F.size("w") >= least, F.transform(F.sequence(F.lit(1), F.size("w") - (least - 1)), run)).otherwise(F.array().cast("array<long>"))
    spans = rows.select("batch", F.explode(F.array_distinct(runs)).alias("span"))
    carried = spans.groupBy("batch", "span").agg(F.count("*").alias("n"))
    by = carried.groupBy("batch").agg(F.sum("n").alias("n_spans"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_ambiguous"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return texts.groupBy("batch").agg(F.count("*").alias("n_documents")).join(by, "batch", "left").select("batch", "n_documents", zero("n_spans"), zero("n_ambiguous"))


def unambiguous_synonyms(names: DataFrame) -> DataFrame:
    """key, attribute: synonyms (attribute, synonym) that mean one attribute; an attribute's own name always means itself."""
    own = names.select(F.col("attribute").alias("key"), "attribute").distinct()
    one = names.groupBy(F.col("synonym").alias("key")).agg(F.min("attribute").alias("attribute"), F.count_distinct("attribute").alias("n")).where("n = 1").drop("n")
    return own.union(one.join(own.select("key"), "key", "left_anti"))


def differing_at_one(names: DataFrame, column: str) -> DataFrame:
    """key, place, n: groups of names that are equal but for one underscore-parted token."""
    parts = names.select(F.split(column, "_").alias("p")).distinct()
    rows = parts.select("p", F.posexplode("p").alias("place", "token"))
    blank = F.array_join(F.transform("p", lambda x, i: F.when(i == F.col("place"), F.lit("*")).otherwise(x)), "_")
    return rows.groupBy(blank.alias("key"), "place").agg(F.count_distinct("token").alias("n")).where("n > 1")


def compare_parameters(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """key, expected, actual, finding of (key, value) tables: missing, orphan or mismatch; equal ones are left out."""
    both = expected.select("key", F.col("value").alias("expected"), F.lit(1).alias("e")).join(actual.select("key", F.col("value").alias("actual"), F.lit(1).alias("a")), "key", "full")
    finding = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "orphan").when(~F.col("expected").eqNullSafe(F.col("actual")), "mismatch")
    return both.withColumn("finding", finding).where("finding is not null").select("key", "expected", "actual", "finding")


def content_hash(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key: sha256 over its rows' values, whatever their order; null as an empty field."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(line, 256))), "\n"), 256).alias("digest"))
