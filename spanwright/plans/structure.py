"""Queries on the structure of traces: hierarchies (problem 1) and time intervals (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.instants import instant_us
from spanwright.operators.hierarchy import hierarchy, members_below
from spanwright.operators.intervals import gaps, periods
from spanwright.session import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy(table(spark, d, "spans"), "trace_id", "id", "parent_id", with_ranges=False)
    return h.select("trace_id", F.col("node_id").alias("span_id"), "root_id", "depth")


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Per span the number of spans below it, its range in the preorder, and where it stands among all (trees, cycles, below cycles)."""
    h = hierarchy(table(spark, d, "spans"), "trace_id", "id", "parent_id")
    return h.select("trace_id", F.col("node_id").alias("span_id"), (F.col("subtree_size") - 1).alias("n_below"), (F.col("rgt") - F.col("lft")).alias("width"), "status")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All spans below each span, by the nested-set ranges: (trace_id, ancestor_id, span_id, distance)."""
    t = Scratch(spark, "descendants").keep(hierarchy(table(spark, d, "spans"), "trace_id", "id", "parent_id"))
    return members_below(t, "trace_id", t.select("trace_id", "node_id")).withColumnRenamed("node_id", "span_id")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy(table(spark, d, "spans"), "trace_id", "id", "parent_id", with_path=True, with_ranges=False)
    return h.filter("path is not null").select("trace_id", F.col("node_id").alias("span_id"), F.array_join("path", "/").alias("path"))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spans")
    return s.select("trace_id", instant_us(F.col("started_at")).alias("s"), instant_us(F.col("ended_at")).alias("e"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return gaps(_intervals(spark, d), "trace_id", "s", "e").select("trace_id", F.col("gap_start").alias("gap_start_us"), F.col("gap_end").alias("gap_end_us"))


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods(_intervals(spark, d), "trace_id", "s", "e").select("trace_id", F.col("period_start").alias("period_start_us"), F.col("period_end").alias("period_end_us"))


QUERIES = {"p1_found": p1_found, "p1_ranges": p1_ranges, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p6_found": p6_found, "p6_periods": p6_periods}

_UP = """
WITH RECURSIVE nodes AS (
  SELECT trace_id, id, min(parent_id) AS parent_id FROM spans WHERE trace_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL
), link AS (
  SELECT n.trace_id, n.id, p.id AS parent FROM nodes n LEFT JOIN nodes p ON p.trace_id = n.trace_id AND p.id = n.parent_id
), up AS (
  SELECT trace_id, id, parent, [id] AS way FROM link
  UNION ALL
  SELECT u.trace_id, u.id, l.parent, list_append(u.way, u.parent) FROM up u
  JOIN link l ON l.trace_id = u.trace_id AND l.id = u.parent WHERE NOT list_contains(u.way, u.parent)
), ended AS (
  SELECT *, list_position(way, parent) AS back FROM up WHERE parent IS NULL OR list_contains(way, parent)
)
"""

_PERIODS = """
WITH v AS (
  SELECT DISTINCT trace_id, epoch_us(CAST(started_at AS TIMESTAMPTZ)) AS s, epoch_us(CAST(ended_at AS TIMESTAMPTZ)) AS e
  FROM spans WHERE trace_id IS NOT NULL
), r AS (
  SELECT *, max(e) OVER (PARTITION BY trace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v WHERE e > s
), g AS (
  SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r
)
"""

SQL = {
    "p1_found": _UP
    + """SELECT trace_id, id AS span_id,
       CASE WHEN parent IS NULL THEN way[len(way)] ELSE list_min(way[back:]) END AS root_id,
       CAST(CASE WHEN parent IS NULL THEN len(way) - 1 WHEN back = 1 THEN -1 ELSE -2 END AS BIGINT) AS depth FROM ended""",
    "p1_ranges": _UP
    + """, below AS (
       SELECT trace_id, unnest(way[2:]) AS id FROM ended WHERE parent IS NULL
     ), n AS (SELECT trace_id, id, count(*) AS n FROM below GROUP BY ALL)
     SELECT e.trace_id, e.id AS span_id,
       CASE WHEN parent IS NULL THEN coalesce(n.n, 0) END AS n_below, CASE WHEN parent IS NULL THEN coalesce(n.n, 0) END AS width,
       CASE WHEN parent IS NULL THEN 'tree' WHEN back = 1 THEN 'cycle' ELSE 'below_cycle' END AS status
     FROM ended e LEFT JOIN n ON n.trace_id = e.trace_id AND n.id = e.id""",
    "p1_descendants": _UP + """, a AS (SELECT trace_id, id AS span_id, unnest(way[2:]) AS ancestor_id, generate_subscripts(way[2:], 1) AS distance FROM ended WHERE parent IS NULL)
       SELECT trace_id, ancestor_id, span_id, CAST(distance AS BIGINT) AS distance FROM a""",
    "p1_paths": _UP + "SELECT trace_id, id AS span_id, array_to_string(list_reverse(way), '/') AS path FROM ended WHERE parent IS NULL",
    "p6_found": _PERIODS + "SELECT trace_id, reached AS gap_start_us, s AS gap_end_us FROM r WHERE s > reached",
    "p6_periods": _PERIODS + "SELECT trace_id, min(s) AS period_start_us, max(e) AS period_end_us FROM g GROUP BY trace_id, k",
}
