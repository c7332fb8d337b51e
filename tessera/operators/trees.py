"""Trees as tables of (node, parent): roots, leaves, siblings, descendants, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.records import ancestors


def _up(nodes: DataFrame) -> DataFrame:
    return ancestors(nodes.select(F.col("node").alias("accession"), "parent")).withColumnRenamed("accession", "node")


def leaves(nodes: DataFrame) -> DataFrame:
    """The nodes without children."""
    return nodes.select("node").distinct().join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")


def siblings(nodes: DataFrame) -> DataFrame:
    """node, n_siblings, first: how many others have its parent, and the least of them; 0 and null for roots.

    Children of a parent are counted, not paired."""
    # the two least children of a parent tell the least sibling of any child
    ranked = nodes.where("parent is not null").select("parent", "node").distinct()
    by = ranked.groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("a"))
    second = ranked.join(by, "parent").where("node <> a").groupBy("parent").agg(F.min("node").alias("b"))
    rows = nodes.select("node", "parent").join(by, "parent", "left").join(second, "parent", "left")
    return rows.select("node", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_siblings"), F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("first"))


def roots(nodes: DataFrame) -> DataFrame:
    """node, root, depth: the topmost ancestor of each node, a root's own being itself; a node of a cycle has none."""
    top = nodes.where("parent is null").select(F.col("node").alias("root"))
    up = _up(nodes).union(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))
    found = up.join(top, F.col("ancestor") == F.col("root")).select("node", "root", F.col("distance").alias("depth"))
    return nodes.select("node").join(found, "node", "left")


def same_family(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with same: whether both have one root."""
    of = roots(nodes)
    one, two = (of.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
    return pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False)).alias("same"))


def runnable_descendants(nodes: DataFrame) -> DataFrame:
    """node, n_runnable: how many nodes below it are runnable (boolean)."""
    below = _up(nodes).join(nodes.where("runnable").select("node"), "node").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n"))
    return nodes.select("node").join(below, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n_runnable"))


def tree_findings(nodes: DataFrame) -> DataFrame:
    """node, finding of (node, parent, family, runnable): self_parent, unknown_parent, cycle, childless_family, leaf_with_children or no_runnable_descendant; a sound tree gives no row.

    family: the node says that it has children. A family that is not runnable itself needs a
    runnable node below."""
    known, parents = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known")), nodes.select(F.col("parent").alias("node"), F.lit(True).alias("has_children")).distinct()
    rows = nodes.join(known, "parent", "left").join(parents, "node", "left").join(runnable_descendants(nodes), "node")
    told, has = F.col("family"), F.coalesce("has_children", F.lit(False))
    itself = F.coalesce(F.col("parent") == F.col("node"), F.lit(False))
    unknown = F.col("parent").isNotNull() & F.col("known").isNull()
    checks = [(itself, "self_parent"), (unknown, "unknown_parent"), (told & ~has, "childless_family"), (~told & has, "leaf_with_children"), (told & ~F.col("runnable") & (F.col("n_runnable") == 0), "no_runnable_descendant")]
    found = rows.select("node", F.explode(F.array_compact(F.array(*(F.when(c, name) for c, name in checks)))).alias("finding"))
    # on a cycle: among its own ancestors
    up = _up_with_self(nodes)
    return found.union(up.where("node = ancestor").join(rows.where(~itself).select("node"), "node", "left_semi").select("node", F.lit("cycle").alias("finding")))


def _up_with_self(nodes: DataFrame) -> DataFrame:
    """node, ancestor, where a node of a cycle is its own."""
    up = _up(nodes).select("node", F.col("ancestor").alias("a"))
    back = nodes.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("ancestor"))
    return up.join(back, "a").where("node = ancestor").select("node", "ancestor").distinct()
