"""Taxonomies and references: nodes with parents, relations, and whether what is cited exists.

Nodes are rows (node_id, parent_id, dimension). Defined results: null ids are no nodes; empty tables give no issues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.hierarchy import hierarchy

# What may relate nodes.
RELATIONS = ["related_to", "broader_than", "narrower_than", "replaces", "excludes"]


def _issue(df: DataFrame, code: str, node: str = "node_id") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(node).alias("node_id"))


def validate(nodes: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Issues (``code``, ``node_id``): repeated nodes, unknown parents, parents of another dimension, cycles; of relations (source_id, target_id, relation) unknown ends and kinds."""
    n = nodes.filter("node_id is not null")
    once = n.groupBy("node_id").agg(F.min("dimension").alias("dimension"), F.count(F.lit(1)).alias("n"))
    out = _issue(once.filter("n > 1"), "duplicate_node")
    kids = n.filter("parent_id is not null")
    out = out.unionByName(_issue(kids.join(once.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti"), "unknown_parent"))
    out = out.unionByName(_issue(kids.join(once.select(F.col("node_id").alias("parent_id"), F.col("dimension").alias("_d")), "parent_id").filter("_d <> dimension"), "parent_of_another_dimension"))
    h = hierarchy(n.withColumn("_all", F.lit("taxonomy")), "_all", "node_id", "parent_id", with_ranges=False)
    out = out.unionByName(_issue(h.filter("status = 'cycle'"), "cycle"))
    if relations is not None:
        for end in ("source_id", "target_id"):
            out = out.unionByName(_issue(relations.join(once.select(F.col("node_id").alias(end)), end, "left_anti"), "unknown_relation_end", end))
        out = out.unionByName(_issue(relations.filter(~F.col("relation").isin(*RELATIONS)), "unknown_relation", "source_id"))
    return out


def lineage(before: DataFrame, after: DataFrame, operations: DataFrame) -> DataFrame:
    """(op_id, ``valid``) of operations (op_id, op, from_ids, to_ids) between two releases: kept, added, removed, renamed, split, merged, moved."""
    ids = lambda df: df.select(F.col("node_id").alias("x")).distinct()
    def known(column: str, table: DataFrame, name: str) -> DataFrame:
        e = operations.select("op_id", F.explode(column).alias("x")).join(ids(table).withColumn("_k", F.lit(True)), "x", "left")
        return e.groupBy("op_id").agg(F.min(F.coalesce("_k", F.lit(False))).alias(name))

    j = operations
    for column, side in (("from_ids", "from"), ("to_ids", "to")):
        for name, t in (("before", before), ("after", after)):
            j = j.join(known(column, t, f"_{side}_{name}"), "op_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    nf, nt = F.size("from_ids"), F.size("to_ids")
    rule = (
        F.when(F.col("op") == "added", (nf == 0) & (nt == 1) & yes("_to_after") & ~F.coalesce("_to_before", F.lit(False)))
        .when(F.col("op") == "removed", (nf == 1) & (nt == 0) & yes("_from_before") & ~F.coalesce("_from_after", F.lit(False)))
        .when(F.col("op").isin("kept", "moved"), (nf == 1) & (nt == 1) & (F.col("from_ids") == F.col("to_ids")) & yes("_from_before") & yes("_to_after"))
        .when(F.col("op") == "renamed", (nf == 1) & (nt == 1) & yes("_from_before") & yes("_to_after"))
        .when(F.col("op") == "split", (nf == 1) & (nt >= 2) & yes("_from_before") & yes("_to_after"))
        .when(F.col("op") == "merged", (nf >= 2) & (nt == 1) & yes("_from_before") & yes("_to_after"))
        .otherwise(F.lit(False))
    )
    return j.select("op_id", F.coalesce(rule, F.lit(False)).alias("valid"))


def unresolved(citations: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Citations whose keys the catalog doesn't have."""
    return citations.join(catalog.select(*keys).distinct(), keys, "left_anti")


def resolve_prefix(asked: DataFrame, catalog: DataFrame, least: int = 12) -> DataFrame:
    """(``prefix``, ``identity``, ``matches``): the catalog's identity (hex text) that a prefix of at least ``least`` characters names; null unless exactly one.

    Both sides meet on their first ``least`` characters.
    """
    a = asked.select(F.col("prefix"), F.substring("prefix", 1, least).alias("_h")).distinct()
    c = catalog.select(F.col("identity").alias("_i"), F.substring("identity", 1, least).alias("_h")).distinct()
    j = a.join(c, "_h", "left").filter(F.col("_i").isNull() | F.startswith("_i", "prefix"))
    g = j.groupBy("prefix").agg(F.count("_i").alias("matches"), F.min("_i").alias("_i"))
    out = a.select("prefix").join(g, "prefix", "left")
    long = F.char_length("prefix") >= least
    return out.select("prefix", F.when(long & (F.col("matches") == 1), F.col("_i")).alias("identity"), F.when(long, F.coalesce("matches", F.lit(0))).otherwise(0).alias("matches"))
