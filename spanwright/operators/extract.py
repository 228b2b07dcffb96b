"""Evaluation cases and their texts from traces.

Defined results: repeated rows of a span are one span; traces without any input give no case (``strict=True`` makes that an error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.attributes import attr, resolved_kind
from spanwright.functions.text import trim_u
from spanwright.operators.behavior import spans_once

CLUSTER_FIELDS = ["route", "task", "task_id", "scenario", "tool", "tool_name", "product_area", "cluster_id", "tags"]


def _pick(value: str, where: Column, last: bool = False) -> Column:
    place = F.when(where, F.col("pos"))
    return (F.max_by if last else F.min_by)(F.struct("id", F.col(value).alias("text"), "attributes"), place)


def _checked(cases: DataFrame, traces: DataFrame | None, strict: bool) -> DataFrame:
    if not strict:
        return cases.filter("input is not null")
    return cases.withColumn("input", F.when(F.col("input").isNull(), F.raise_error(F.concat(F.lit("no input in trace "), F.col("trace_id")))).otherwise(F.col("input")))


def simple_cases(spans: DataFrame, strict: bool = False) -> DataFrame:
    """A case a trace: the first model call with input (else the first span with input), the last with output (else the last span with output)."""
    s = spans_once(spans, "pos", "kind", "input", "output", "attributes", *(["ingested_at"] if "ingested_at" in spans.columns else []))
    llm = F.col("kind") == "llm"
    g = s.groupBy("trace_id").agg(
        _pick("input", llm & F.col("input").isNotNull()).alias("i1"), _pick("input", F.col("input").isNotNull()).alias("i2"),
        _pick("output", llm & F.col("output").isNotNull(), True).alias("o1"), _pick("output", F.col("output").isNotNull(), True).alias("o2"),
    )
    g = g.select("trace_id", F.coalesce("i1", "i2").alias("i"), F.coalesce("o1", "o2").alias("o"))
    c = g.select(F.concat_ws(":", "trace_id", "i.id").alias("id"), "trace_id", F.col("i.text").alias("input"), F.col("o.text").alias("actual_output"), F.create_map(F.lit("source_span_id"), F.col("i.id"), F.lit("output_span_id"), F.col("o.id")).alias("metadata"))
    return _checked(c, None, strict)


def openinference_cases(spans: DataFrame, traces: DataFrame | None = None, strict: bool = False, with_tool_calls: bool = True) -> DataFrame:
    """A case a trace: input from the root agent or chain, else a model call, else any span; output likewise from the end; texts may stand in attributes.

    ``metadata`` (map): the trace's, then attributes of the input span, then of the output span (the first to name a key wins),
    then ``tool_calls`` (JSON list of tool spans), ``source_span_id``, ``output_span_id``, ``extractor``.
    """
    s = spans_once(spans, "pos", "parent_id", "name", "kind", "input", "output", "attributes", *(["ingested_at"] if "ingested_at" in spans.columns else []))
    s = s.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    s = s.withColumns({"_k": resolved_kind(F.col("kind"), F.col("attributes")), "_in": F.coalesce("input", attr(F.col("attributes"), "input.value")), "_out": F.coalesce("output", attr(F.col("attributes"), "output.value"))})
    root = F.col("parent_id").isNull() & F.col("_k").isin("agent", "chain")
    llm = F.col("_k") == "llm"
    has_in, has_out = F.col("_in").isNotNull(), F.col("_out").isNotNull()
    g = s.groupBy("trace_id").agg(
        *[_pick("_in", w & has_in).alias(f"i{k}") for k, w in enumerate((root, llm, F.lit(True)))], *[_pick("_out", w & has_out, True).alias(f"o{k}") for k, w in enumerate((root, llm, F.lit(True)))]
    )
    g = g.select("trace_id", F.coalesce("i0", "i1", "i2").alias("i"), F.coalesce("o0", "o1", "o2").alias("o"))
    none = F.create_map().cast("map<string,string>")
    if traces is not None:
        t = traces.groupBy(F.col("id").alias("trace_id")).agg(F.first("metadata", ignorenulls=True).alias("_m"))
        g = g.join(t, "trace_id", "left")
    else:
        g = g.withColumn("_m", none)
    own = F.create_map(F.lit("source_span_id"), F.col("i.id"), F.lit("extractor"), F.lit("openinference"), F.lit("output_span_id"), F.col("o.id"))
    if with_tool_calls:
        tools = s.filter("_k = 'tool'").groupBy("trace_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("span_id"), F.col("name").alias("tool_name"), F.to_json("attributes").alias("attributes"))))).alias("_tools"))
        g = g.join(tools, "trace_id", "left")
        own = F.map_concat(own, F.create_map(F.lit("tool_calls"), F.coalesce("_tools", F.lit("[]"))))
    own = F.map_filter(own, lambda k, v: v.isNotNull())

    def under(lower: Column, upper: Column) -> Column:  # entries of ``lower`` that ``upper`` doesn't name, and all of ``upper``
        return F.map_concat(F.map_filter(lower, lambda k, v: ~F.map_contains_key(upper, k)), upper)

    first = under(F.coalesce("i.attributes", none), F.coalesce("_m", none))
    merged = under(under(F.coalesce("o.attributes", none), first), own)
    c = g.select(F.concat_ws(":", "trace_id", "i.id").alias("id"), "trace_id", F.col("i.text").alias("input"), F.col("o.text").alias("actual_output"), merged.alias("metadata"))
    return _checked(c, traces, strict)


def cluster_text(cases: DataFrame, with_actual: bool = False, fields: list[str] | None = None) -> DataFrame:
    """(id, ``text``, ``text_hash``): the texts of a case under their names, blank ones left out, for embedding."""
    names = ["input", "rubric", "expected_output"] + (["actual_output"] if with_actual else [])
    parts = [F.struct(F.lit(n).alias("n"), trim_u(F.col(n)).alias("v")) for n in names]
    parts += [F.struct(F.lit(n).alias("n"), trim_u(F.try_element_at(F.col("metadata"), F.lit(n))).alias("v")) for n in (fields or CLUSTER_FIELDS)]
    kept = F.filter(F.array(*parts), lambda p: p["v"] != "")
    text = F.array_join(F.transform(kept, lambda p: F.concat(p["n"], F.lit(":\n"), p["v"])), "\n\n")
    return cases.select("id", text.alias("text")).withColumn("text_hash", F.sha2("text", 256))
