"""Judgements by a language model: bounded inputs for it, checks of what it says, findings from it.

The model is a function from a list of prompts to a list of JSON texts, called on batches in the tasks; the library brings none. What a
judge says is checked before it counts: verdict, score 1..4, confidence 0..1, evidence keys only of the catalog. An unusable answer is an
abstention with score 2 and confidence 0.

Defined results: traces without facts give a prompt with an empty catalog; null answers are abstentions; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import hash_parts, hash_text, is_label
from spanwright.operators.detectors import Facts

MOST_CALLS = 64
VERDICTS = ["pass", "fail", "abstain"]
JUDGMENT = "verdict string, score int, confidence double, evidence array<string>, reason string"


def safe_label(text: Column) -> Column:
    """A bounded label as it is, any other text as its hash."""
    return F.when(text.isNull() | is_label(text), text).otherwise(hash_text(text))


def projections(f: Facts, most: int = MOST_CALLS) -> DataFrame:
    """(trace_id, ``facts`` JSON, ``catalog`` array of (key, identity), ``truncated``, ``projection_hash``, ``projection_id``): the first ``most`` calls and decisions of a trace, labels only."""
    c = f.calls.filter(F.col("idx") < most).select("trace_id", F.struct("idx", safe_label(F.col("tool_name")).alias("tool"), safe_label(F.col("operation")).alias("operation"), "effect", "status", safe_label(F.col("error_kind")).alias("error")).alias("x"), "evidence")
    calls = c.groupBy("trace_id").agg(F.array_sort(F.collect_list("x")).alias("_calls"), F.flatten(F.collect_list("evidence")).alias("_ev"))
    size = f.calls.groupBy("trace_id").agg((F.count(F.lit(1)) > most).alias("truncated"))
    d = f.decisions.groupBy("trace_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", safe_label(F.col("action")).alias("action"), "outcome"))), 1, most).alias("_dec"))
    o = f.outcomes.select("trace_id", "final_status", "escalation", F.concat(F.lit("span:"), F.col("root_id")).alias("_root"))
    t = o.join(calls, "trace_id", "left").join(size, "trace_id", "left").join(d, "trace_id", "left")
    ids = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("_ev", F.array().cast("array<string>")), F.array("_root")))))
    catalog = F.transform(ids, lambda x, i: F.struct(F.concat(F.lit("e"), (i + 1).cast("string")).alias("key"), x.alias("identity")))
    facts = F.to_json(F.struct("final_status", "escalation", F.col("_calls").alias("calls"), F.col("_dec").alias("decisions")))
    t = t.select("trace_id", facts.alias("facts"), catalog.alias("catalog"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    t = t.withColumn("projection_hash", hash_text(F.to_json(F.struct("facts", "catalog", "truncated"))))
    return t.withColumn("projection_id", hash_parts(F.lit("semantic_behavior_projection"), F.col("trace_id"), F.col("projection_hash")))


def judge_prompt(rubric: str) -> Callable[[Column, Column], Column]:
    def build(facts: Column, catalog: Column) -> Column:
        return F.concat(F.lit(f"Judge the run below by this rubric: {rubric}\nAnswer as JSON with verdict (pass, fail or abstain), score (1 to 4), confidence (0 to 1), evidence (keys) and reason.\nFacts: "), facts, F.lit("\nEvidence keys: "), F.array_join(F.transform(catalog, lambda c: c["key"]), " "))

    return build


def judged(p: DataFrame, prompt: Callable[[Column, Column], Column], model: Callable[[list[str]], list[str]], minimum_confidence: float = 0.0) -> DataFrame:
    """Projections with a checked judgement: ``verdict``, ``score``, ``confidence``, ``evidence`` identities, ``reason``, ``valid``."""
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(model(s.tolist()), index=s.index)

    answer = F.pandas_udf(ask, "string")
    x = p.withColumn("_a", answer(prompt(F.col("facts"), F.col("catalog")))).withColumn("j", F.from_json("_a", JUDGMENT))
    known = F.map_from_entries("catalog")
    cited = F.coalesce("j.evidence", F.array().cast("array<string>"))
    ok = F.col("j.verdict").isin(*VERDICTS) & F.col("j.score").between(1, 4) & F.col("j.confidence").between(0, 1) & F.forall(cited, lambda k: F.map_contains_key(known, k)) & ((F.col("j.verdict") != "fail") | (F.size(cited) > 0))
    x = x.withColumn("valid", F.coalesce(ok, F.lit(False)))
    pick = lambda good, bad: F.when(F.col("valid"), good).otherwise(bad)
    return x.select(
        "trace_id", "projection_id", pick(F.col("j.verdict"), F.lit("abstain")).alias("verdict"), pick(F.col("j.score"), F.lit(2)).alias("score"), pick(F.col("j.confidence"), F.lit(0.0)).alias("confidence"), pick(F.transform(cited, lambda k: F.try_element_at(known, k)), F.array().cast("array<string>")).alias("evidence"), F.col("j.reason").alias("reason"), "valid"
    )


def findings_of(j: DataFrame, kind: str, rubric: str, minimum_confidence: float = 0.7, with_abstentions: bool = False) -> DataFrame:
    """Findings of judgements: a confident fail is high and actionable, another fail is info for review; a pass gives none; abstentions only if asked for."""
    x = j.filter(F.col("verdict").isin("fail", *(["abstain"] if with_abstentions else [])))
    sure = (F.col("verdict") == "fail") & (F.col("confidence") >= minimum_confidence)
    return x.select(
        hash_parts(F.col("trace_id"), F.lit(f"semantic_{kind}"), F.lit("1"), F.lit(rubric), more=F.array_sort(F.array_distinct("evidence"))).alias("finding_id"),
        F.lit(f"semantic_{kind}").alias("detector_id"),
        "trace_id",
        F.when(sure, "high").otherwise("info").alias("severity"),
        F.lit("unknown").alias("recovery"),
        hash_parts(F.lit(f"semantic_{kind}"), F.lit(kind), F.lit(rubric)).alias("failure_signature"),
        "evidence",
        "confidence",
        (~sure).alias("needs_review"),
    )


def results_of(j: DataFrame, evaluator: str) -> DataFrame:
    """Evaluation results on the four-point scale."""
    return j.select(F.col("trace_id").alias("case_id"), "trace_id", F.lit(evaluator).alias("evaluator_name"), F.col("score").cast("double").alias("raw_score"), ((F.col("score") - 1) / 3.0).alias("normalized_score"), F.lit("four_point").alias("score_scale"), (F.col("verdict") == "pass").alias("passed"), "confidence")


def embedded(texts: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], dimensions: int) -> DataFrame:
    """(key, ``vector``, ``text_hash``) by an embedding function called on batches; another number or length of vectors is an error."""
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            got = model(s.tolist())
            if len(got) != len(s) or any(len(v) != dimensions for v in got):
                raise ValueError("the model gave another number or length of vectors")
            yield pd.Series(got, index=s.index)

    return texts.select(key, F.pandas_udf(ask, "array<float>")(F.col(text)).alias("vector"), F.sha2(text, 256).alias("text_hash"))
