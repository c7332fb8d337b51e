"""Queries and functions take all rows, ties included."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def test_short_count_ties_are_as_printf(spark):
    numbers = [0, 999, 1000, 1049, 999_949, 999_950, 999_999, (1 << 62) + 50_000_000]
    numbers += [k * unit // 20 for unit in (1000, 10**6, 10**9) for k in range(21, 20000, 2)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")

    def want(n):
        for unit, sign in ((10**9, "B"), (10**6, "M"), (1000, "K")):
            if n >= unit:
                return f"{n / unit:.1f}{sign}"
        return str(n)

    got = rows.select("n", text.short_count(F.col("n")).alias("short")).collect()
    assert [(r.n, r.short) for r in got if r.short != want(r.n)] == []


def test_best_assignment_takes_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = registry.QUERIES["best_assignment"](spark, SF)
    assert got.count() == orders.select("o_custkey").distinct().count()
