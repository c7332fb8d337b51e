"""Stacks of sparse matrices in coordinates: layers and samples over one axis of features and one of cells.

A layer's matrix has axes of its own; on the stack's, a feature is known by its name and a cell by its sample and barcode. Nothing is
made dense, and the axes are counted, not gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import stored


def _axis(names: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys with at, their place (from 0) in sorted order: by ranges, each counting from where the ones before it end."""
    own = names.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    own = stored(own.select("*", F.spark_partition_id().alias("part")), "axis")  # a range's number holds from here on
    sizes = own.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return own.withColumn("place", place).join(F.broadcast(before), "part").select(*keys, (F.col("place") + F.col("before")).alias("at"))


def differing_axes(features: DataFrame, primary: str) -> DataFrame:
    """layer, sample: layers whose features (layer, sample, at, name) are not those of the primary layer, in the same order; they can't be layers of one object without being aligned."""
    own = features.groupBy("layer", "sample").agg(F.count("*").alias("n"), F.sum(F.xxhash64("at", "name").cast("decimal(38,0)")).alias("h"))
    head = own.where(F.col("layer") == primary).select("sample", F.col("n").alias("n0"), F.col("h").alias("h0"))
    return own.where(F.col("layer") != primary).join(head, "sample", "left").where(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0")))).select("layer", "sample")


def stack(entries: DataFrame, features: DataFrame, barcodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, features and cells of a stack.

    entries: layer, sample, row (of a feature), column (of a barcode), value; features: layer, sample, at, name; barcodes: layer, sample, at, name. Places are
    from 0. Returns entries (layer, cell, feature, value), features (at, name) in order of name, and cells (at, sample, name) in order of sample and
    name: those that some layer counts; a barcode that no layer counts is no cell. A feature that a layer lacks has no entry in it; repeated entries of
    one place are added, and zeros are none. A place that an axis lacks raises no error here: see ``stray_entries``."""
    counted = entries.where("value <> 0")
    named = counted.join(features.select("layer", "sample", F.col("at").alias("row"), F.col("name").alias("feature")), ["layer", "sample", "row"])
    named = named.join(barcodes.select("layer", "sample", F.col("at").alias("column"), F.col("name").alias("barcode")), ["layer", "sample", "column"])
    named = named.groupBy("layer", "sample", "barcode", "feature").agg(F.sum("value").alias("value"))
    feature_axis = _axis(features, ["name"])
    cells = _axis(named.select("sample", F.col("barcode").alias("name")), ["sample", "name"])
    rows = named.join(feature_axis.select(F.col("name").alias("feature"), F.col("at").alias("f")), "feature")
    rows = rows.join(cells.select("sample", F.col("name").alias("barcode"), F.col("at").alias("cell")), ["sample", "barcode"])
    return rows.select("layer", "cell", F.col("f").alias("feature"), "value"), feature_axis.select("at", "name"), cells.select("at", "sample", "name")


def stray_entries(entries: DataFrame, features: DataFrame, barcodes: DataFrame) -> DataFrame:
    """layer, sample, strays: how many entries lie outside their axes, of layers that have any."""
    key = ["layer", "sample"]
    own = entries.join(features.select(*key, F.col("at").alias("row"), F.lit(1).alias("f")), [*key, "row"], "left").join(barcodes.select(*key, F.col("at").alias("column"), F.lit(1).alias("b")), [*key, "column"], "left")
    return own.where("f is null or b is null").groupBy(*key).agg(F.count("*").alias("strays"))
