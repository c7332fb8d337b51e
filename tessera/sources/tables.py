"""Readers and writers of the plain tables around a sequencing dataset; every schema is stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNITS = "sample string, run string, lane string, read string, path string"
JUNCTIONS = "contig string, start long, end long, strand int, motif int, annotated int, unique long, multi long, overhang int"


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=UNITS, sep="\t", header=True, mode="FAILFAST")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated text with a header; white space inside a cell becomes one space."""
    clean = [F.regexp_replace(F.col(c).cast("string"), r"\s+", " ").alias(c) for c in rows.columns]
    rows.select(*clean).write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """contig, feature, start (0-based), end (exclusive), gene, name and biotype of an annotation's rows."""
    raw = spark.read.csv(path, schema="contig string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string", sep="\t", comment="#", quote="")
    value = lambda key: F.nullif(F.regexp_extract("attributes", rf'(?:^|; ?){key} "([^"]*)"', 1), F.lit(""))
    return raw.select("contig", "feature", (F.col("start") - 1).alias("start"), "end", value("gene_id").alias("gene"), value("gene_name").alias("name"), F.coalesce(value("gene_type"), value("gene_biotype")).alias("biotype"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """file, row, column (0-based), value of the coordinate matrices of a path: comments and each file's line of sizes are left out.

    The line of sizes is a file's first that is no comment, found by its place in the file."""
    text = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("at")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    sizes = text.groupBy("file").agg(F.min("at").alias("sizes"))  # a row for each file
    parts = F.split(F.trim("value"), r"\s+")
    rows = text.join(sizes, "file").where("at > sizes")
    return rows.select("file", (parts[0].cast("long") - 1).alias("row"), (parts[1].cast("long") - 1).alias("column"), parts[2].cast("double").alias("value"))


def write_matrix_market(entries: DataFrame, path: str, rows: int, columns: int) -> None:
    """Writes entries (row, column, value; 0-based) as one coordinate matrix of these sizes, in order of column, then row."""
    count = entries.count()
    head = entries.sparkSession.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate integer general"), (-1, 0, f"{rows} {columns} {count}")], "column long, row long, value string")
    line = F.concat_ws(" ", F.col("row") + 1, F.col("column") + 1, F.col("value").cast("long"))
    body = entries.select(F.col("column").cast("long"), F.col("row").cast("long"), line.alias("value"))
    head.union(body).coalesce(1).sortWithinPartitions("column", "row").select("value").write.text(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """file, at (from 0), name and fields (what stands behind a tab) of files that list one feature or barcode to a line, in order; empty lines are left out."""
    text = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("line")).where("value <> ''")
    at = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    parts = F.split("value", "\t")
    return text.select("file", at.cast("long").alias("at"), parts[0].alias("name"), F.slice(parts, 2, 99).alias("fields"))


def read_key_values(spark: SparkSession, path: str, separator: str = r"\s*\|\s*") -> DataFrame:
    """key, value of log lines ``label | value``; others are left out."""
    parts = F.split(F.trim("value"), separator, 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("key"), F.trim(parts[1]).alias("value"))


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=JUNCTIONS, sep="\t", mode="DROPMALFORMED")


def junction_totals(junctions: DataFrame) -> DataFrame:
    return junctions.agg(F.count("*").alias("junctions"), F.count_if(F.col("annotated") == 1).alias("annotated"), F.count_if(F.col("motif") > 0).alias("canonical"), F.coalesce(F.sum("unique"), F.lit(0)).alias("unique_reads"), F.coalesce(F.sum("multi"), F.lit(0)).alias("multi_reads"))


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Fragments by contig, each file in order of start."""
    fragments.repartitionByRange("contig", "start").sortWithinPartitions("contig", "start", "end", "barcode").write.partitionBy("contig").parquet(path)


def read_file_report(spark: SparkSession, path: str) -> DataFrame:
    """Run inventories as archives give them: tab-separated with a header, all columns as text; blank lines are left out, short rows end in nulls."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False, mode="PERMISSIVE")
    return rows.where(F.coalesce(*(F.col(f"`{c}`") for c in rows.columns)).isNotNull())


def report_files(runs: DataFrame) -> DataFrame:
    """run_accession, url, md5, size of runs whose fastq_ftp, fastq_md5 and fastq_bytes hold lists parted by semicolons.

    Lists are paired by place; addresses and sums of different numbers give no pair at all,
    sizes of a different number or form 0."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    rows = runs.select("run_accession", parts("fastq_ftp").alias("u"), parts("fastq_md5").alias("m"), parts("fastq_bytes").alias("b")).where("size(u) = size(m)")
    sizes = F.when(F.size("b") == F.size("u"), F.col("b")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("run_accession", F.explode(F.arrays_zip("u", "m", sizes.alias("b"))).alias("x"))
    size = F.when(F.col("x.b").rlike(r"^\d+$"), F.col("x.b").try_cast("long"))
    return rows.select("run_accession", F.concat(F.lit("https://"), "x.u").alias("url"), F.col("x.m").alias("md5"), F.coalesce(size, F.lit(0)).alias("size"))
