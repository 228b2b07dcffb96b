"""Queries pN_... of this package and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.instants import instant_us
from spanwright.llm.consensus import Consensus, on_scale, usable
from spanwright.llm.defects import defects
from spanwright.llm.encoding import encode
from spanwright.llm.leakage import leaks
from spanwright.llm.patterns import frequent
from spanwright.llm.personal import personal
from spanwright.llm.runs import collapse
from spanwright.llm.shared import SharedStretches
from spanwright.llm.steps import error_key, step_of, tool_key
from spanwright.session import table


def _tool():
    return F.try_element_at(F.col("attributes"), F.lit("gen_ai.tool.name"))


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run of tool calls, single ones included, with count and duration."""
    return _runs(spark, d, 1)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 2).select("trace_id", "first_span_id", "last_span_id", "n_events")


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    s = table(spark, d, "spans").withColumn("_tool", _tool()).filter(F.regexp_replace("_tool", r"(?U)\s+", "") != "")
    key = F.concat_ws("\x1f", tool_key(F.col("_tool")), error_key(F.col("error")))
    r = collapse(s, "trace_id", instant_us(F.col("started_at")), F.col("pos"), F.col("id"), key, instant_us(F.col("ended_at")), least)
    return r.select("trace_id", F.col("first_id").alias("first_span_id"), F.col("last_id").alias("last_span_id"), "n_events", (F.col("end_us") - F.col("start_us")).alias("duration_us"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spans")
    p = frequent(s, "trace_id", instant_us(F.col("started_at")), F.col("pos"), F.col("id"), step_of(F.col("kind"), F.col("name"), F.col("attributes")))
    return p.select(*[F.col("steps")[i].alias(f"step_{i + 1}") for i in range(3)], "support")


SCALE = ["resolved", "partly_resolved", "unresolved", "harmful"]


def _consensus(spark: SparkSession, d: str) -> Consensus:
    return Consensus(usable(table(spark, d, "agreement_ratings"), "item_id", "rater_id", on_scale(F.col("label"), SCALE), "rated_at"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items.filter("n_annotators >= 3").select(F.col("_i").alias("item_id"), "label")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per item of at least two raters their number and the share of agreeing pairs among them."""
    i = _consensus(spark, d).items.filter("n_annotators >= 2")
    return i.select(F.col("_i").alias("item_id"), "n_annotators", F.round("agreement", 6).alias("agreement"))


def p3_raters(spark: SparkSession, d: str) -> DataFrame:
    a = _consensus(spark, d).annotators
    return a.select(F.col("_a").alias("rater_id"), "n_labels", F.round("accuracy", 6).alias("accuracy"), F.round("weight", 6).alias("reliability"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedStretches(table(spark, d, "documents"), "doc_id", "text").pairs().select(F.col("_a").alias("doc_id_a"), F.col("_b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """Of each document of 500 characters or more how much stands elsewhere too."""
    return SharedStretches(table(spark, d, "documents"), "doc_id", "text").coverage().withColumnRenamed("_d", "doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "cases"), "id", "input", "actual_output", "expected_output").withColumnRenamed("id", "case_id")


def _personal(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    fields = {"input": F.col("input"), "output": F.col("output"), "input.value": F.try_element_at(F.col("attributes"), F.lit("input.value"))}
    s = table(spark, d, "spans").withColumnRenamed("id", "span_id")
    return personal(s, ["trace_id", "span_id"], fields, with_text=with_text).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, False)


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All texts of spans with placeholders for personal items."""
    return _personal(spark, d, True)


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p4_found": p4_found, "p3_found": p3_found, "p3_agreement": p3_agreement, "p3_raters": p3_raters, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_shared": p10_shared, "p5_found": p5_found, "p5_runs": p5_runs, "p7_found": p7_found}

_EVENTS = r"""
WITH once AS (
  SELECT trace_id, id, any_value(epoch_us(CAST(started_at AS TIMESTAMPTZ))) AS s, any_value(epoch_us(CAST(ended_at AS TIMESTAMPTZ))) AS e,
    any_value(pos) AS pos, any_value(attributes['gen_ai.tool.name']) AS tool, any_value(error) AS error,
    any_value(CASE WHEN lower(trim(kind)) = 'other' THEN coalesce(lower(attributes['openinference.span.kind']), 'other') ELSE lower(kind) END || '/' || lower(trim(name))) AS step
  FROM spans WHERE started_at IS NOT NULL GROUP BY trace_id, id
)
"""

_RUNS = _EVENTS + r""", ev AS (
  SELECT *, regexp_replace(lower(tool), '[\s_-]+', '', 'g') || chr(31) || CASE WHEN coalesce(trim(error), '') = '' THEN ''
    ELSE '!' || regexp_replace(regexp_replace(regexp_replace(lower(trim(error)), '\S*\d\S*', '', 'g'), '\s+', '', 'g'), '\.$', '') END AS k
  FROM once WHERE trim(tool) <> ''
), f AS (
  SELECT *, CASE WHEN lag(k) OVER w = k THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY trace_id ORDER BY s, pos)
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS run FROM f
), r AS (
  SELECT trace_id, arg_min(id, (s, pos)) AS first_span_id, arg_max(id, (s, pos)) AS last_span_id, count(*) AS n_events,
    max(greatest(s, coalesce(e, s))) - min(s) AS duration_us FROM g GROUP BY trace_id, run
)
"""

SQL = {
    "p3_agreement": r"""
    WITH u AS (
      SELECT item_id, rater_id, rated_at, regexp_replace(lower(trim(label)), '[ -]', '_', 'g') AS l FROM agreement_ratings WHERE item_id IS NOT NULL AND rater_id IS NOT NULL
    ), o AS (SELECT item_id, rater_id, arg_max(l, rated_at) AS l FROM u WHERE l IN ('resolved', 'partly_resolved', 'unresolved', 'harmful') GROUP BY ALL),
    c AS (SELECT item_id, l, count(*) AS v FROM o GROUP BY ALL)
    SELECT item_id, CAST(sum(v) AS BIGINT) AS n_annotators, round(sum(v * (v - 1)) / (sum(v) * (sum(v) - 1.0)), 6) AS agreement FROM c GROUP BY item_id HAVING sum(v) >= 2""",
    "p5_found": _RUNS + "SELECT trace_id, first_span_id, last_span_id, n_events FROM r WHERE n_events >= 2",
    "p5_runs": _RUNS + "SELECT * FROM r",
    "p7_found": _EVENTS
    + r""", q AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s, pos) AS i FROM once),
    edge AS (SELECT trace_id, step, min(i) AS f, max(i) AS l FROM q GROUP BY ALL),
    common AS (SELECT step FROM edge GROUP BY step HAVING count(*) >= 6 AND count(*) * 100 >= 8 * (SELECT count(DISTINCT trace_id) FROM once)),
    mids AS (SELECT q.trace_id, q.step, q.i FROM q JOIN common USING (step)),
    -- of a middle step only its places between the sets of steps begun and of steps to come matter
    m AS (SELECT DISTINCT m.trace_id, m.step,
            (SELECT count(*) FROM edge x WHERE x.trace_id = m.trace_id AND x.f < m.i) AS nf, (SELECT count(*) FROM edge x WHERE x.trace_id = m.trace_id AND x.l > m.i) AS nl FROM mids m),
    fr AS (SELECT trace_id, step, rank() OVER (PARTITION BY trace_id ORDER BY f) AS r FROM edge),
    lr AS (SELECT trace_id, step, rank() OVER (PARTITION BY trace_id ORDER BY l DESC) AS r FROM edge),
    has AS (SELECT DISTINCT a.trace_id, a.step AS step_1, m.step AS step_2, c.step AS step_3 FROM m
            JOIN fr a ON a.trace_id = m.trace_id AND a.r <= m.nf JOIN lr c ON c.trace_id = m.trace_id AND c.r <= m.nl
            WHERE a.step IN (SELECT step FROM common) AND c.step IN (SELECT step FROM common))
    SELECT step_1, step_2, step_3, count(*) AS support FROM has GROUP BY ALL
    HAVING count(*) >= 6 AND count(*) * 100 >= 8 * (SELECT count(DISTINCT trace_id) FROM once)""",
}
