"""Molecule counting: rows of (cell, gene, umi) to corrected counts in long form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def umi_counts(reads: DataFrame) -> DataFrame:
    """cell, gene, umi, n; an empty or missing umi is no molecule."""
    return reads.where("umi <> ''").groupBy("cell", "gene", "umi").agg(F.count("*").alias("n"))


def correct_umis(counts: DataFrame, keys: tuple[str, ...] = ("cell", "gene")) -> DataFrame:
    """Directional merge of molecules one mismatch apart inside each key: keys, umi, n.

    Seeds go by falling count, then umi. A seed takes up a neighbour of count c if
    2 * c - 1 <= the seed's own first count; what was taken up is no seed. One shuffle by key;
    tasks walk over sorted batches and hold one key at a time, which has distinct molecules,
    at most as many as there are strings of their length."""
    rows = counts.select(*keys, "umi", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, own = None, None, {}
        out: tuple[list, list, list] = [], [], []  # keys, umis, counts

        def flush() -> pa.RecordBatch:
            cols = [pa.array([k[c] for k in out[0]], schema.field(c).type) for c in range(len(keys))]
            batch = pa.RecordBatch.from_arrays([*cols, pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], schema=schema)
            for part in out:
                part.clear()
            return batch

        def end() -> None:
            merged = _merged(own) if len(own) > 1 else own
            out[0].extend([held] * len(merged))
            out[1].extend(merged.keys())
            out[2].extend(merged.values())

        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in keys), pa.field("umi", pa.string()), pa.field("n", pa.int64())])
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            for key, umi, n in zip(names, batch.column("umi").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if key != held:
                    if own:
                        end()
                    held, own = key, {}
                own[umi] = own.get(umi, 0) + n
            if len(out[0]) > 20000:
                yield flush()
        if own:
            end()
        if out[0]:
            yield flush()

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{schema}, umi string, n long")


def _merged(first: dict[str, int]) -> dict[str, int]:
    """Molecules of one key after the merge, by umi."""
    letters = set().union(*first)
    total, taken = dict(first), set()
    for seed in sorted(first, key=lambda u: (-first[u], u)):
        if seed in taken:
            continue
        for k, own in enumerate(seed):
            head, tail = seed[:k], seed[k + 1 :]
            for base in letters:
                other = head + base + tail
                if base != own and other in first and other not in taken and 2 * first[other] - 1 <= first[seed]:
                    taken.add(other)
                    total[seed] += first[other]
    return {u: total[u] for u in sorted(first) if u not in taken}


def molecule_layers(reads: DataFrame) -> DataFrame:
    """cell, gene, layer, molecules of rows with a region (exon, intron); layer all corrects the union, which is not the sum."""
    by_region = reads.where("umi <> ''").groupBy("cell", "gene", "region", "umi").agg(F.count("*").alias("n"))
    layers = by_region.select("cell", "gene", F.explode(F.array("region", F.lit("all"))).alias("layer"), "umi", "n")
    out = correct_umis(layers.groupBy("cell", "gene", "layer", "umi").agg(F.sum("n").alias("n")), ("cell", "gene", "layer"))
    return out.groupBy("cell", "gene", "layer").agg(F.count("*").alias("molecules"))


def saturation(reads: DataFrame) -> DataFrame:
    """Per cell: 1 - molecules / fragments with a umi; null without any."""
    by = reads.where("umi <> ''").groupBy("cell", "gene", "umi").count().groupBy("cell").agg(F.count("*").alias("molecules"), F.sum("count").alias("fragments"))
    return by.select("cell", "molecules", "fragments", (1 - F.try_divide("molecules", "fragments")).alias("saturation"))


def hit_histogram(alignments: DataFrame) -> DataFrame:
    """cell, hits, n: how many fragments have how many hits."""
    return alignments.groupBy("cell", "hits").agg(F.count("*").alias("n"))


def kept_barcodes(matrix: DataFrame) -> DataFrame:
    """Entries of barcodes that are non-zero in any layer: cell, gene, layer, n."""
    return matrix.join(matrix.where("n <> 0").select("cell").distinct(), "cell", "left_semi")
