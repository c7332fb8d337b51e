"""Queries over molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import molecules as ops
from tessera.plans.registry import query
from tessera.plans.views import view, with_views


@query(with_views("SELECT cell, gene, umi, count(*) AS n FROM umis WHERE umi <> '' GROUP BY cell, gene, umi", "umis"))
def umi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.umi_counts(view(spark, sf_dir, "umis"))


@query()  # sequential merging has no SQL form: tested against brute force
def umi_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.correct_umis(ops.umi_counts(view(spark, sf_dir, "umis")))


@query()  # as above
def molecule_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.molecule_layers(view(spark, sf_dir, "umis"))


@query(with_views("SELECT cell, count(DISTINCT (gene, umi)) AS molecules, count(*) AS fragments, 1 - count(DISTINCT (gene, umi)) / count(*) AS saturation FROM umis WHERE umi <> '' GROUP BY cell", "umis"))
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.saturation(view(spark, sf_dir, "umis"))


@query(with_views("SELECT cell, hits, count(*) AS n FROM umis GROUP BY cell, hits", "umis"))
def hit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hit_histogram(view(spark, sf_dir, "umis"))


@query(
    with_views(
        """WITH m AS (SELECT cell, gene, region AS layer, count(*) FILTER (cell % 7 <> 0) AS n FROM umis GROUP BY cell, gene, region)
SELECT * FROM m WHERE cell IN (SELECT cell FROM m WHERE n <> 0)""",
        "umis",
    )
)
def kept_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = view(spark, sf_dir, "umis").groupBy("cell", "gene", F.col("region").alias("layer")).agg(F.count_if(F.col("cell") % 7 != 0).alias("n"))
    return ops.kept_barcodes(matrix)
