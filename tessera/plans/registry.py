"""The registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "per_cycle_composition"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


from tessera.plans import bundle_queries, equivalence_queries, frame_queries, gate_queries, interval_queries, metric_queries, molecule_queries, predicate_queries, read_queries, read_set_queries, record_queries, source_queries, text_queries, tree_queries, variant_queries  # noqa: E402, F401  they register
