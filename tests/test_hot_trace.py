"""Queries on findings where one trace has more calls than a task should hold: the same rows as without that limit, from every detector."""

import pytest
from pyspark.sql import functions as F
from test_behavior import call, frame, labelled, span

from spanwright.operators import detectors as D
from spanwright.operators.slices import spread_join
from spanwright.plans import behaviour as P
from spanwright.session import Scratch

QUERIES = ["approval_bypass", "evidence_packet", "finding_gate", "findings_with_traces", "novel_signatures", "remediation", "telemetry_diagnostics", "uncertain_mutation_state", "excessive_tool_usage", "finding_projections", "kind_rates", "policy_violation", "repeated_tool_failure", "terminal_tool_failure", "unresolved_escalation", "eval_candidates", "false_success_claim", "findings_by_detector", "missing_resolution", "recurrence_compare", "signature_groups", "tool_call_loop"]


def rows():
    end = "2025-03-20T00:00:00Z"
    hot = [
        span("hot", 0, "root", "agent", None, end=end, agent__final__status="incomplete", agent__escalation__status="required_and_missing", agent__outcome__claims='[{"operation":"pay","status":"succeeded"}]'),
        span("hot", 1, "d1", "guardrail", agent__policy__outcome="denied", policy__action="send", policy__id="v1"), span("hot", 2, "d2", "guardrail", agent__policy__outcome="required", policy__action="escalate_now"),
        call("hot", 3, "send", status="ok", agent__approval__required="true", agent__approval__outcome="denied"), call("hot", 4, "pay", error="timed out", effect="mutating", retry="non_idempotent"),
        *(call("hot", 5 + i, "look", inp='{"q": "x"}', error="boom", end=end) for i in range(30)),
    ]
    early = [span("early", 0, "root", "agent", None, end="2025-01-02T00:00:00Z", agent__final__status="incomplete"), *(call("early", 1 + i, "look", inp='{"q": "x"}', error="boom") for i in range(3))]
    return hot + early + labelled()


@pytest.fixture(scope="module")
def facts(spark):
    made = [D.Facts.of(frame(spark, rows()), limit=n) for n in (1_000, 5)]
    assert made[0].big is None and made[1].big is not None
    return [(f, Scratch(spark, "all").keep(D.detect(f))) for f in made]


@pytest.mark.parametrize("name", QUERIES)
def test_hot_trace(spark, sf, facts, monkeypatch, name):
    got, detect = [], D.detect
    for f, found in facts:
        monkeypatch.setattr(P, "_facts", lambda spark, d, f=f: f)
        monkeypatch.setattr(D, "detect", lambda f, names=None, limits=None, found=found: detect(f, names, limits) if names else found)
        got.append(sorted(map(str, P.QUERIES[name](spark, sf).collect())))
    assert got[0] == got[1]
    assert got[0] or name == "findings_with_traces"  # none of these traces is in that table
    if name in D.DETECTORS:
        assert any("trace_id='hot'" in r for r in got[1])


def test_spread_join_of_maps(spark):
    left = spark.range(40).select(F.when(F.col("id") < 30, "hot").otherwise("cold").alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    big = spark.createDataFrame([("hot",)], "k string")
    got = spread_join(left, spark.createDataFrame([("hot", 1)], "k string, v int"), ["k"], "k", big).collect()
    assert sorted((r["m"]["a"], r["v"]) for r in got) == [(i, 1 if i < 30 else None) for i in range(40)]
