"""Queries on behaviour: normalised calls, recovery, detectors, findings and what is made of them, completion features, run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import behavior as B
from spanwright.operators import compare as X
from spanwright.operators import completion as T
from spanwright.operators import detectors as D
from spanwright.operators import findings as G
from spanwright.operators import verify as V
from spanwright.plans.evaluation import ONCE
from spanwright.session import Scratch, table

SPLIT = "2025-03-15"


def _facts(spark: SparkSession, d: str) -> D.Facts:
    return D.Facts.of(table(spark, d, "spans"), table(spark, d, "tool_mappings"))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    c = B.calls(table(spark, d, "spans"), table(spark, d, "tool_mappings"))
    return c.select("trace_id", "span_id", "idx", "call_id", "tool_name", "operation", "operation_quality", "effect", "retry_safety", "requirement", "status", "status_quality", "error_kind", "attempt", "duration_ms", "invocation_quality", "progress")


def trace_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return B.outcomes(table(spark, d, "spans")).select("trace_id", "root_id", "final_status", "escalation")


def trace_coverage(spark: SparkSession, d: str) -> DataFrame:
    return B.coverage(table(spark, d, "spans"))


def recovery_status(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).recovery()


def _detector(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return D.detect(_facts(spark, d), [name]).select("trace_id", "recovery", "subject", "operation", "error_kind", F.array_join("evidence", ",").alias("evidence"), "finding_id", "failure_signature")

    run.__name__ = name
    return run


def failure_episodes(spark: SparkSession, d: str) -> DataFrame:
    return D.failure_episodes(_facts(spark, d), D.Limits(repeated_failures=2)).drop("places")


def call_loops(spark: SparkSession, d: str) -> DataFrame:
    return D.loops(_facts(spark, d), D.Limits(loop_calls=2))


def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    return D.tool_usage(_facts(spark, d))


def detector_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = D.detector_coverage(_facts(spark, d))
    return c.select("trace_id", "detector_id", "status", F.array_join("missing_facts", ",").alias("missing_facts"), F.round("semantic_coverage", 6).alias("semantic_coverage"))


def telemetry_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_report(_facts(spark, d))[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return D.detect(_facts(spark, d))


def findings_by_detector(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("detector_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces"))


def signature_groups(spark: SparkSession, d: str) -> DataFrame:
    return G.signature_groups(_findings(spark, d)).select("group_id", "failure_signature", "occurrence_count", "severity", F.col("trace_count").alias("n_traces"), "finding_hash")


def kind_rates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "spans").agg(F.count_distinct("trace_id")).first()[0]
    return G.rates_by_kind(_findings(spark, d), n).withColumn("affected_trace_rate", F.round("affected_trace_rate", 6))


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = Scratch(spark, "findings").keep(_findings(spark, d))  # read several times
    return f.filter(F.col("created_at") < SPLIT), f.filter(F.col("created_at") >= SPLIT)


def recurrence_compare(spark: SparkSession, d: str) -> DataFrame:
    """The findings before ``SPLIT`` against those from then on; observed are the traces whose last instant lies in the window."""
    f = _facts(spark, d)
    found = Scratch(spark, "findings").keep(D.detect(f))  # read several times
    n = f.outcomes.agg(F.count_if(F.col("observed_at") < SPLIT), F.count_if(F.col("observed_at") >= SPLIT)).first()
    b, c = found.filter(F.col("created_at") < SPLIT), found.filter(F.col("created_at") >= SPLIT)
    r = G.recurrence(b, c, b.filter("severity = 'high'").select("failure_signature").distinct(), (n[0], n[1]))
    return r.select("baseline_occurrence_count", "candidate_occurrence_count", "baseline_affected_trace_count", "candidate_affected_trace_count", F.round("baseline_recurrence_rate", 6).alias("baseline_rate"), F.round("candidate_recurrence_rate", 6).alias("candidate_rate"), F.col("severe_novel_count").alias("n_severe_novel"), "evidence_complete")


def novel_signatures(spark: SparkSession, d: str) -> DataFrame:
    return G.novel_findings(*_windows(spark, d)).select("finding_id", "failure_signature")


def finding_gate(spark: SparkSession, d: str) -> DataFrame:
    b, c = _windows(spark, d)
    g = V.finding_gate(b, c, b.filter("severity = 'critical' or detector_id = 'repeated_tool_failure'").select("failure_signature"))
    return g.select("target_count", "baseline_reproduced", "candidate_resolved", "no_severe_novel_findings", "passed")


def remediation(spark: SparkSession, d: str) -> DataFrame:
    """Whether the traces from ``SPLIT`` on hold to what those before showed: findings and the use of tools, a row a gate."""
    f = _facts(spark, d)
    found = Scratch(spark, "findings").keep(D.detect(f))
    b, c = found.filter(F.col("created_at") < SPLIT), found.filter(F.col("created_at") >= SPLIT)
    when = f.calls.join(f.outcomes.select("trace_id", "observed_at"), "trace_id")
    use = [V.usage(when.filter(x)) for x in (F.col("observed_at") < SPLIT, F.col("observed_at") >= SPLIT)]
    budget = V.budget_gate_rows(*use, {"tool_calls": 0}, ["tool_calls", "duration_ms", "traces"])
    return V.remediation(V.finding_gate(b, c, b.filter("severity = 'high'").select("failure_signature")), budget=budget)


def evidence_packet(spark: SparkSession, d: str) -> DataFrame:
    return G.evidence_packet(Scratch(spark, "findings").keep(_findings(spark, d))).select("trace_count", "finding_count", "evidence_count", "trace_hash", "finding_hash", "evidence_hash", "created_at")


def finding_projections(spark: SparkSession, d: str) -> DataFrame:
    return G.projections(_findings(spark, d)).select("finding_id", "text", "text_hash", "truncated")


def eval_candidates(spark: SparkSession, d: str) -> DataFrame:
    return G.candidates(_findings(spark, d)).select("candidate_id", "finding_id", "definition_hash", "status")


def findings_with_traces(spark: SparkSession, d: str) -> DataFrame:
    return G.with_traces(_findings(spark, d), table(spark, d, "traces")).groupBy("detector_id", F.try_element_at("trace_metadata", F.lit("cluster_id")).alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))


def _completion(spark: SparkSession, d: str) -> DataFrame:
    return T.facts(table(spark, d, "spans"), table(spark, d, "tool_mappings"))


def completion_facts(spark: SparkSession, d: str) -> DataFrame:
    return _completion(spark, d).select("trace_id", "sequence", "evidence_id", "span_id", "actor", "kind", "status", "tool_name", "lane", "mandatory", "relevance")


def first_success_after_failure(spark: SparkSession, d: str) -> DataFrame:
    return T.recovery_chains(_completion(spark, d)).drop("family")


def compact_projections(spark: SparkSession, d: str) -> DataFrame:
    return T.projected(_completion(spark, d), "complete", 400)[1]


def completion_prompts(spark: SparkSession, d: str) -> DataFrame:
    f, p = T.projected(_completion(spark, d), "mandatory_with_recovery", 6144, "Judge the task.")
    return T.prompts(f, p, "mandatory_with_recovery", "Judge the task.")


def completion_features(spark: SparkSession, d: str) -> DataFrame:
    f, p = T.projected(_completion(spark, d), "complete", 400)
    return T.features(f, p, 400).select("trace_id", *[F.round(c, 6).alias(c) for c in T.FEATURES])


def run_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Traces of a cluster (those without one form one too), side by side in the order of their ids: each odd one against the next, a last one without a mate against nothing."""
    from pyspark.sql import Window as W

    t = table(spark, d, "traces").groupBy("id").agg(F.first(F.try_element_at("metadata", F.lit("cluster_id")), ignorenulls=True).alias("c")).filter("id is not null").withColumn("c", F.coalesce("c", F.lit("")))
    t = t.withColumn("n", F.row_number().over(W.partitionBy("c").orderBy("id")) - 1).select(F.col("id").alias("trace_id"), F.concat_ws(":", "c", F.floor(F.col("n") / 2).cast("string")).alias("pair_id"), (F.col("n") % 2).alias("side"))
    s = X.steps(B.spans_once(table(spark, d, "spans"), "pos", "parent_id", "name", "kind", "source_status", "attributes", "ingested_at")).join(t, "trace_id")
    s = Scratch(spark, "alignment").keep(s.drop("trace_id"))
    return X.compare_runs(s.filter("side = 0").drop("side"), s.filter("side = 1").select(*[F.col(c).alias(c) for c in s.columns if c != "side"]), most=None).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("common_prefix_steps").alias("common_prefix_steps"), F.count_if(F.col("relation") == "changed").alias("changed"), F.max("baseline_unmatched").alias("baseline_unmatched"), F.max("candidate_unmatched").alias("candidate_unmatched"))


QUERIES = {f.__name__: f for f in (tool_calls, trace_outcomes, trace_coverage, recovery_status)} | {n: _detector(n) for n in D.DETECTORS} | {
    f.__name__: f for f in (failure_episodes, call_loops, tool_usage, detector_coverage, telemetry_diagnostics, findings_by_detector, signature_groups, kind_rates, recurrence_compare, novel_signatures, finding_gate, remediation, evidence_packet, finding_projections, eval_candidates, findings_with_traces, completion_facts, first_success_after_failure, compact_projections, completion_prompts, completion_features, run_alignment)
}

_CALLS = f"""WITH {ONCE}, maps AS (SELECT tool_name AS tn, min(operation) AS op, min(effect) AS ef, min(retry_safety) AS rs, min(requirement) AS rq FROM tool_mappings WHERE tool_name IS NOT NULL GROUP BY tool_name),
b AS (SELECT k.*, coalesce(attributes['gen_ai.tool.name'], name, '') AS tool_name, attributes['agent.operation'] AS told_op, lower(coalesce(attributes['agent.tool.status'], '')) AS told, lower(coalesce(error, '')) AS el,
  CASE WHEN json_valid(output) THEN coalesce(CASE lower(json_extract_string(output, '$.success')) WHEN 'true' THEN true WHEN 'yes' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN 'no' THEN false WHEN '0' THEN false END,
    CASE lower(json_extract_string(output, '$.ok')) WHEN 'true' THEN true WHEN 'yes' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN 'no' THEN false WHEN '0' THEN false END,
    CASE WHEN json_type(output, '$.error') = 'NULL' THEN true WHEN json_type(output, '$.error') IS NOT NULL THEN false END) END AS res,
  row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS idx FROM kinds k WHERE k = 'tool'),
s AS (SELECT *, CASE WHEN res = false THEN 'failed' WHEN told LIKE '%timeout%' OR el LIKE '%timeout%' OR el LIKE '%timed out%' THEN 'timed_out' WHEN told LIKE '%cancel%' OR el LIKE '%cancel%' THEN 'cancelled'
  WHEN source_status = 'error' OR error IS NOT NULL OR told IN ('failed', 'failure', 'error') THEN 'failed' WHEN told IN ('unknown', 'uncertain', 'ambiguous', 'incomplete') THEN 'unknown'
  WHEN source_status = 'ok' OR res = true OR told IN ('succeeded', 'success', 'ok', 'completed') THEN 'succeeded' END AS st FROM b LEFT JOIN maps ON tn = tool_name),
calls AS (SELECT trace_id, pos, id AS span_id, idx, CASE WHEN regexp_full_match(coalesce(attributes['gen_ai.tool.call.id'], ''), '[!-~]{{1,256}}') THEN attributes['gen_ai.tool.call.id'] ELSE id END AS call_id, tool_name,
  coalesce(CASE WHEN regexp_full_match(told_op, '[A-Za-z0-9_.:/-]{{1,128}}') THEN told_op END, op) AS operation, CASE WHEN regexp_full_match(coalesce(told_op, ''), '[A-Za-z0-9_.:/-]{{1,128}}') THEN 'explicit' WHEN op IS NOT NULL THEN 'derived' ELSE 'missing' END AS operation_quality,
  coalesce(ef, 'unknown') AS effect, coalesce(rs, 'unknown') AS retry_safety, coalesce(rq, 'unknown') AS requirement, coalesce(st, 'unknown') AS status, CASE WHEN res = false AND source_status = 'ok' THEN 'ambiguous' WHEN st IS NULL THEN 'missing' ELSE 'explicit' END AS status_quality,
  CASE WHEN coalesce(st, 'unknown') = 'succeeded' THEN NULL WHEN st = 'timed_out' THEN 'timeout' WHEN st = 'cancelled' THEN 'cancelled' WHEN st IS NULL OR st = 'unknown' THEN 'unknown' WHEN el LIKE '%rate limit%' OR el LIKE '%429%' THEN 'rate_limited'
    WHEN el LIKE '%denied%' OR el LIKE '%forbidden%' OR el LIKE '%unauthorized%' THEN 'permission_denied' WHEN el LIKE '%invalid%' OR el LIKE '%validation%' THEN 'invalid_request' WHEN el LIKE '%network%' OR el LIKE '%connection%' THEN 'network' ELSE 'tool_error' END AS error_kind,
  coalesce(CAST(floor((greatest(epoch_us(CAST(ended_at AS TIMESTAMPTZ)) - epoch_us(CAST(started_at AS TIMESTAMPTZ)), 0) + 500) / 1000) AS BIGINT), 0) AS duration_ms, started_at,
  coalesce(attributes['input.value'], input) AS fp, CASE WHEN coalesce(attributes['input.value'], input) IS NULL THEN 'missing' ELSE 'derived' END AS invocation_quality,
  coalesce(st, 'unknown') = 'succeeded' AND coalesce(ef, 'unknown') IN ('verifying', 'compensating', 'escalating') AS progress, coalesce(attributes['input.value'], '') <> '' AS by_attr FROM s),
roots AS (SELECT trace_id, id, error, ended_at, attributes, CASE WHEN parent_id IS NULL AND k = 'agent' THEN 0 WHEN k = 'agent' AND (input IS NOT NULL OR output IS NOT NULL) THEN 1 WHEN parent_id IS NULL AND k IN ('agent', 'chain') THEN 2 END AS c, pos FROM kinds),
root AS (SELECT trace_id, arg_min(id, (c, pos)) AS root_id FROM roots WHERE c IS NOT NULL GROUP BY trace_id),
outcomes AS (SELECT t.trace_id, r.root_id, coalesce(CASE lower(k.attributes['agent.final.status']) WHEN 'complete' THEN 'completed' WHEN 'completed' THEN 'completed' WHEN 'failure' THEN 'failed' WHEN 'failed' THEN 'failed' WHEN 'error' THEN 'failed' WHEN 'safely_refused' THEN 'safely_refused' WHEN 'safe_refusal' THEN 'safely_refused'
    WHEN 'escalated' THEN 'escalated' WHEN 'escalation' THEN 'escalated' WHEN 'incomplete' THEN 'incomplete' WHEN 'missing' THEN 'incomplete' WHEN 'unknown' THEN 'unknown' WHEN 'uncertain' THEN 'unknown' END, CASE WHEN k.error IS NOT NULL THEN 'failed' ELSE 'unknown' END) AS final_status, 'unknown' AS escalation, k.ended_at
  FROM (SELECT DISTINCT trace_id FROM once) t LEFT JOIN root r ON r.trace_id = t.trace_id LEFT JOIN kinds k ON k.trace_id = r.trace_id AND k.id = r.root_id),
rec AS (SELECT c.*, CASE WHEN status = 'succeeded' THEN 'recovered'
  WHEN retry_safety = 'idempotent' AND fp IS NOT NULL AND EXISTS (SELECT 1 FROM calls l WHERE l.trace_id = c.trace_id AND l.idx > c.idx AND l.status = 'succeeded' AND l.tool_name = c.tool_name AND l.operation IS NOT DISTINCT FROM c.operation AND l.effect = c.effect AND l.fp = c.fp AND l.by_attr = c.by_attr) THEN 'recovered'
  WHEN EXISTS (SELECT 1 FROM calls l WHERE l.trace_id = c.trace_id AND l.idx > c.idx AND l.status = 'succeeded' AND l.tool_name = c.tool_name AND l.operation IS NOT DISTINCT FROM c.operation AND l.effect = c.effect) THEN 'unknown'
  WHEN status = 'unknown' THEN 'unknown' ELSE 'unrecovered' END AS recovery FROM calls c)
"""
_FOUND = "SELECT trace_id, recovery, tool_name AS subject, operation, error_kind, 'span:' || span_id AS evidence, {id} AS finding_id, {sig} AS failure_signature FROM rec WHERE "


def _hashed(parts: list[str]) -> str:
    framed = " || ".join(f"unhex(lpad(hex(octet_length(encode({p}))), 16, '0')) || encode({p})" for p in parts)
    return f"'sha256:' || sha256({framed})"


def _of(detector: str) -> str:
    return _CALLS + _FOUND.format(id=_hashed(["trace_id", f"'{detector}'", "'6'", "'span:' || span_id"]), sig=_hashed([f"'{detector}'", "tool_name", "coalesce(operation, '')", "coalesce(error_kind, '')"]))


_ALL = """, f AS (SELECT 'terminal_tool_failure' AS detector_id, 'high' AS severity, trace_id FROM rec WHERE requirement = 'required' AND status IN ('failed', 'timed_out', 'cancelled') AND recovery = 'unrecovered'
  UNION ALL SELECT 'uncertain_mutation_state', 'high', trace_id FROM rec WHERE effect = 'mutating' AND status IN ('timed_out', 'unknown') AND recovery <> 'recovered'
  UNION ALL SELECT 'missing_resolution', 'medium', trace_id FROM outcomes WHERE final_status IN ('incomplete', 'unknown')
  UNION ALL SELECT 'excessive_tool_usage', 'medium', trace_id FROM calls GROUP BY trace_id HAVING count(*) > 25 OR sum(duration_ms) > 60000)"""

SQL = {
    "tool_calls": _CALLS + "SELECT trace_id, span_id, idx, call_id, tool_name, operation, operation_quality, effect, retry_safety, requirement, status, status_quality, error_kind, row_number() OVER (PARTITION BY trace_id, tool_name, operation ORDER BY pos) AS attempt, duration_ms, invocation_quality, progress FROM calls",
    "trace_outcomes": _CALLS + "SELECT trace_id, root_id, final_status, escalation FROM outcomes",
    "trace_coverage": f"""WITH {ONCE} SELECT trace_id, count(*) AS n_spans, count(*) FILTER (coalesce(source_status, 'unset') <> 'unset') AS explicit_status_spans, count(*) FILTER (started_at IS NOT NULL AND ended_at IS NOT NULL) AS timed_spans,
      CASE WHEN bool_or(coalesce(attributes['agent.operation'] IS NOT NULL, false)) THEN 'explicit' ELSE 'missing' END AS operation_identity, CASE WHEN bool_or(coalesce(attributes['agent.final.status'] IS NOT NULL, false)) THEN 'explicit' ELSE 'missing' END AS final_outcome,
      CASE WHEN bool_or(kind = 'evaluator') THEN 'explicit' ELSE 'missing' END AS verifier FROM once GROUP BY trace_id""",
    "recovery_status": _CALLS + "SELECT trace_id, idx, recovery FROM rec",
    "terminal_tool_failure": _of("terminal_tool_failure") + "requirement = 'required' AND status IN ('failed', 'timed_out', 'cancelled') AND recovery = 'unrecovered'",
    "uncertain_mutation_state": _of("uncertain_mutation_state") + "effect = 'mutating' AND status IN ('timed_out', 'unknown') AND recovery <> 'recovered'",
    "missing_resolution": _CALLS
    + f"SELECT trace_id, 'unrecovered' AS recovery, 'final_outcome' AS subject, CAST(NULL AS VARCHAR) AS operation, CAST(NULL AS VARCHAR) AS error_kind, coalesce('span:' || root_id, '') AS evidence, CASE WHEN root_id IS NULL THEN {_hashed(['trace_id', chr(39) + 'missing_resolution' + chr(39), chr(39) + '6' + chr(39)])} ELSE {_hashed(['trace_id', chr(39) + 'missing_resolution' + chr(39), chr(39) + '6' + chr(39), chr(39) + 'span:' + chr(39) + ' || root_id'])} END AS finding_id, {_hashed([chr(39) + 'missing_resolution' + chr(39), chr(39) + 'final_outcome' + chr(39), chr(39) * 2, chr(39) * 2])} AS failure_signature FROM outcomes WHERE final_status IN ('incomplete', 'unknown')",
    "tool_usage": _CALLS + "SELECT trace_id, count(*) AS tool_call_count, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM calls GROUP BY trace_id",
    "failure_episodes": _CALLS
    + """, ev AS (SELECT trace_id, idx, status, sum(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY idx) AS seg, tool_name, coalesce('operation:' || operation, 'tool:' || tool_name) AS who, fp, by_attr, coalesce(error_kind, 'unknown') AS ek,
        CASE WHEN status IN ('failed', 'timed_out', 'cancelled') AND fp IS NOT NULL THEN 1 END AS elig FROM calls),
      q AS (SELECT *, row_number() OVER (PARTITION BY trace_id, seg, tool_name, who, fp, by_attr, ek ORDER BY idx) AS r FROM ev WHERE elig = 1),
      walk AS (SELECT trace_id, seg, tool_name, who, fp, by_attr, ek, list(idx ORDER BY idx) AS l FROM q GROUP BY ALL),
      fold AS (SELECT trace_id, list_reduce(list_transform(l, lambda i: [[i, i, 1]]), lambda acc, x: CASE WHEN x[1][1] - acc[len(acc)][1] < 8 THEN list_concat(acc[1:len(acc) - 1], [[acc[len(acc)][1], x[1][1], acc[len(acc)][3] + 1]]) ELSE list_concat(acc, x) END) AS e FROM walk),
      u AS (SELECT trace_id, unnest(e) AS e FROM fold) SELECT trace_id, e[1] AS first_idx, e[2] AS last_idx, e[3] AS n FROM u WHERE e[3] >= 2""",
    "findings_by_detector": _CALLS + _ALL + " SELECT detector_id, severity, count(*) AS n, count(DISTINCT trace_id) AS traces FROM f GROUP BY ALL",
    "findings_with_traces": _CALLS + _ALL + ", t AS (SELECT id, any_value(metadata['cluster_id']) AS cluster_id FROM traces GROUP BY id) SELECT detector_id, cluster_id, count(*) AS n FROM f JOIN t ON t.id = f.trace_id GROUP BY ALL",
    "kind_rates": _CALLS + _ALL + " SELECT detector_id AS kind, count(*) AS occurrence_count, count(DISTINCT trace_id) AS affected_trace_count, round(count(DISTINCT trace_id) / (SELECT count(DISTINCT trace_id) FROM spans), 6) AS affected_trace_rate FROM f GROUP BY ALL",
    "detector_coverage": _CALLS
    + """, g AS (SELECT trace_id, count(*) AS n, count(*) FILTER (status IN ('failed', 'timed_out', 'cancelled')) AS nf, count(*) FILTER (status IN ('failed', 'timed_out', 'cancelled') AND fp IS NOT NULL) AS nr, count(*) FILTER (fp IS NOT NULL) AS ne,
        bool_and(status_quality = 'explicit') AS source_status, bool_and(operation IS NOT NULL) AS operation_identity, coalesce(bool_and(fp IS NOT NULL) FILTER (status IN ('failed', 'timed_out', 'cancelled')), true) AS invocation_fingerprint,
        bool_and(duration_ms > 0) AS numeric_duration, coalesce(bool_and(requirement <> 'unknown') FILTER (status IN ('failed', 'timed_out', 'cancelled')), true) AS tool_requirement, bool_and(effect <> 'mutating') AS state_observation FROM calls GROUP BY trace_id),
      t AS (SELECT o.trace_id, coalesce(n, 0) AS n, coalesce(nf, 0) AS nf, coalesce(nr, 0) AS nr, coalesce(ne, 0) AS ne, coalesce(source_status, true) AS source_status, coalesce(operation_identity, true) AS operation_identity, coalesce(invocation_fingerprint, true) AS invocation_fingerprint,
        coalesce(numeric_duration, true) AS numeric_duration, coalesce(tool_requirement, true) AS tool_requirement, coalesce(state_observation, true) AS state_observation, true AS tool_identity, false AS policy_semantics,
        (SELECT bool_or(coalesce(attributes['agent.final.status'] IS NOT NULL, false)) FROM once x WHERE x.trace_id = o.trace_id) AS final_outcome FROM outcomes o LEFT JOIN g ON g.trace_id = o.trace_id),
      d(detector_id, facts, calls_only) AS (VALUES """
    + ", ".join(f"('{k}', {v}, {k in D.NEEDS_CALLS})" for k, v in D.REQUIRED_FACTS.items())
    + """),
      x AS (SELECT t.*, d.detector_id, CASE WHEN calls_only AND n = 0 THEN [] ELSE facts END AS need FROM t, d),
      m AS (SELECT *, list_filter(need, lambda f: NOT CASE f WHEN 'source_status' THEN source_status WHEN 'operation_identity' THEN operation_identity WHEN 'invocation_fingerprint' THEN invocation_fingerprint WHEN 'numeric_duration' THEN numeric_duration
        WHEN 'tool_requirement' THEN tool_requirement WHEN 'state_observation' THEN state_observation WHEN 'tool_identity' THEN tool_identity WHEN 'policy_semantics' THEN policy_semantics ELSE final_outcome END) AS miss FROM x)
      SELECT trace_id, detector_id, CASE WHEN CASE detector_id WHEN 'repeated_tool_failure' THEN nr >= 3 OR (nf < 3 AND source_status) WHEN 'tool_call_loop' THEN ne >= 4 OR n < 4 ELSE len(miss) = 0 END THEN 'evaluated' ELSE 'inconclusive' END AS status,
        array_to_string(miss, ',') AS missing_facts, round(CASE WHEN len(need) = 0 THEN 1 ELSE (len(need) - len(miss)) / len(need) END, 6) AS semantic_coverage FROM m""",
}


def _frame(x: str) -> str:
    return f"(unhex(lpad(hex(octet_length(encode({x}))), 16, '0')) || encode({x}))"


_BITS = "('0x' || substr(sha256({0}), 1, 15))::BIGINT"
_FINDINGS = (
    _CALLS
    + """, seen AS (SELECT o.trace_id, coalesce(o.ended_at, l.last, nullif(c.last, ''), 'unknown') AS created_at FROM outcomes o
    LEFT JOIN (SELECT trace_id, arg_max(ended_at, pos) AS last FROM kinds WHERE ended_at IS NOT NULL GROUP BY trace_id) l ON l.trace_id = o.trace_id
    LEFT JOIN (SELECT trace_id, arg_max(coalesce(started_at, ''), idx) AS last FROM calls GROUP BY trace_id) c ON c.trace_id = o.trace_id),
  raw AS (SELECT 'terminal_tool_failure' AS detector_id, 'high' AS severity, trace_id, recovery, tool_name AS subject, operation, error_kind, ['span:' || span_id] AS evidence FROM rec WHERE requirement = 'required' AND status IN ('failed', 'timed_out', 'cancelled') AND recovery = 'unrecovered'
    UNION ALL SELECT 'uncertain_mutation_state', 'high', trace_id, recovery, tool_name, operation, error_kind, ['span:' || span_id] FROM rec WHERE effect = 'mutating' AND status IN ('timed_out', 'unknown') AND recovery <> 'recovered'
    UNION ALL SELECT 'missing_resolution', 'medium', trace_id, 'unrecovered', 'final_outcome', NULL, NULL, CASE WHEN root_id IS NULL THEN [] ELSE ['span:' || root_id] END FROM outcomes WHERE final_status IN ('incomplete', 'unknown')
    UNION ALL SELECT 'approval_bypass', 'critical', c.trace_id, 'unrecovered', tool_name, operation, error_kind, ['span:' || span_id] FROM calls c JOIN kinds k ON k.trace_id = c.trace_id AND k.id = c.span_id WHERE status = 'succeeded' AND lower(k.attributes['agent.approval.required']) IN ('true', 'yes', '1') AND lower(coalesce(k.attributes['agent.approval.outcome'], '')) NOT IN ('approved', 'allow', 'allowed')
    UNION ALL SELECT 'excessive_tool_usage', 'medium', trace_id, 'unrecovered', 'tool_budget', NULL, NULL, list_sort(list('span:' || span_id) FILTER (idx < 10000)) FROM calls GROUP BY trace_id HAVING count(*) > 25 OR sum(duration_ms) > 60000),
  found AS (SELECT raw.*, created_at, 'sha256:' || sha256("""
    + f"{_frame('raw.trace_id')} || {_frame('detector_id')} || {_frame(chr(39) + '6' + chr(39))} || list_reduce(list_concat([''::BLOB], list_transform(evidence, lambda e: {_frame('e')})), lambda x, y: x || y)) AS finding_id, "
    + _hashed(["detector_id", "subject", "coalesce(operation, '')", "coalesce(error_kind, '')"])
    + """ AS failure_signature FROM raw LEFT JOIN seen ON seen.trace_id = raw.trace_id)"""
)
_WINDOWS = _FINDINGS + f", wb AS (SELECT * FROM found WHERE created_at < '{SPLIT}'), wc AS (SELECT * FROM found WHERE created_at >= '{SPLIT}')"
_NOVEL = "FROM wc WHERE severity IN ('high', 'critical') AND failure_signature NOT IN (SELECT failure_signature FROM wb)"
_ONE = "SELECT trace_id, recovery, subject, operation, error_kind, array_to_string(evidence, ',') AS evidence, finding_id, failure_signature FROM found WHERE detector_id = "


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3))"


def _summary(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {t} = '' THEN '{T.NO_SUMMARY}' WHEN length({t}) > {T.SUMMARY} THEN substr({t}, 1, {T.SUMMARY}) || '{T.CUT}' ELSE {t} END"


_SAID = "concat_ws(' ', tool_name, " + ", ".join(f"CASE WHEN length(k.attributes['{x}']) <= {B.FACT_CHARS} THEN '{x}=' || k.attributes['{x}'] END" for x in B.FACT_KEYS) + ")"
_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(said, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{kind}'" for kind, ws in T.TOOL_WORDS.items()) + " ELSE 'tool_result' END"
_FACTS = (
    _CALLS
    + f""", own AS (SELECT o.trace_id, {_summary("k.input")} AS request, {_summary("k.output")} AS answer FROM outcomes o JOIN kinds k ON k.trace_id = o.trace_id AND k.id = o.root_id),
  t AS (SELECT c.trace_id, c.pos AS place, span_id, tool_name, translate({_SAID}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS said, CASE WHEN k.error IS NOT NULL OR k.source_status = 'error' THEN 'failed' WHEN k.source_status = 'ok' THEN 'succeeded' ELSE 'unknown' END AS status,
    {_summary("k.input")} AS i, {_summary("k.output")} AS o FROM calls c JOIN kinds k ON k.trace_id = c.trace_id AND k.id = c.span_id),
  cand AS (SELECT trace_id, place, span_id, 'tool' AS actor, {_KIND} AS kind, status, tool_name, coalesce(o, i, tool_name || ' returned ' || upper(status[1]) || status[2:]) AS summary, o IS NULL AS mute FROM t
    UNION ALL SELECT trace_id, -1, NULL, 'user', 'user_request', 'succeeded', NULL, request, true FROM own WHERE request IS NOT NULL
    UNION ALL SELECT trace_id, 1152921504606846976, NULL, 'assistant', 'assistant_message', 'succeeded', NULL, answer, true FROM own WHERE answer IS NOT NULL),
  facts AS (SELECT cand.*, row_number() OVER (PARTITION BY cand.trace_id ORDER BY place) - 1 AS sequence, actor <> 'tool' OR status = 'failed' OR kind IN ('verification', 'artifact_mutation', 'external_action') OR mute AS mandatory,
    len(list_intersect({_words("summary")}, {_words(f"coalesce(request, '{T.NO_GOAL}')")})) AS relevance FROM cand LEFT JOIN own ON own.trace_id = cand.trace_id),
  ev AS (SELECT *, 'E' || CASE WHEN sequence < 9999 THEN lpad(CAST(sequence + 1 AS VARCHAR), 4, '0') ELSE CAST(sequence + 1 AS VARCHAR) END AS evidence_id, lower(tool_name) AS family FROM facts)
"""
)

SQL |= {
    "signature_groups": _FINDINGS + f" SELECT 'sha256:' || sha256(encode('known_signature') || {_frame('failure_signature')}) AS group_id, failure_signature, count(*) AS occurrence_count, any_value(severity) AS severity, count(DISTINCT trace_id) AS n_traces, bit_xor({_BITS.format('finding_id')}) AS finding_hash FROM found GROUP BY failure_signature",
    "excessive_tool_usage": _FINDINGS + " " + _ONE + "'excessive_tool_usage'",
    "approval_bypass": _FINDINGS + " " + _ONE + "'approval_bypass'",
    "novel_signatures": _WINDOWS + " SELECT finding_id, failure_signature " + _NOVEL,
    "recurrence_compare": _WINDOWS
    + f""", t AS (SELECT DISTINCT failure_signature FROM wb WHERE severity = 'high'), n AS (SELECT count(*) FILTER (created_at < '{SPLIT}') AS nb, count(*) FILTER (created_at >= '{SPLIT}') AS nc FROM (SELECT o.trace_id, coalesce(o.ended_at, l.last) AS created_at FROM outcomes o LEFT JOIN (SELECT trace_id, arg_max(ended_at, pos) AS last FROM kinds WHERE ended_at IS NOT NULL GROUP BY trace_id) l ON l.trace_id = o.trace_id)),
      x AS (SELECT (SELECT count(*) FROM wb SEMI JOIN t USING (failure_signature)) AS bo, (SELECT count(*) FROM wc SEMI JOIN t USING (failure_signature)) AS co, (SELECT count(DISTINCT trace_id) FROM wb SEMI JOIN t USING (failure_signature)) AS ba, (SELECT count(DISTINCT trace_id) FROM wc SEMI JOIN t USING (failure_signature)) AS ca)
      SELECT bo AS baseline_occurrence_count, co AS candidate_occurrence_count, ba AS baseline_affected_trace_count, ca AS candidate_affected_trace_count, round(ba / nullif(nb, 0), 6) AS baseline_rate, round(ca / nullif(nc, 0), 6) AS candidate_rate, (SELECT count(*) {_NOVEL}) AS n_severe_novel, nb > 0 AND nc > 0 AS evidence_complete FROM x, n""",
    "finding_gate": _WINDOWS
    + f""", t AS (SELECT DISTINCT failure_signature FROM wb WHERE severity = 'critical' OR detector_id = 'repeated_tool_failure'),
      x AS (SELECT (SELECT count(*) FROM t) AS target_count, (SELECT count(*) FROM t) > 0 AS baseline_reproduced, NOT EXISTS (SELECT 1 FROM t SEMI JOIN wc USING (failure_signature)) AS candidate_resolved, NOT EXISTS (SELECT 1 {_NOVEL}) AS no_severe_novel_findings)
      SELECT *, baseline_reproduced AND candidate_resolved AND no_severe_novel_findings AS passed FROM x""",
    "evidence_packet": _FINDINGS
    + f""", e AS (SELECT DISTINCT unnest(evidence) AS id FROM found)
      SELECT (SELECT count(DISTINCT trace_id) FROM found) AS trace_count, (SELECT count(DISTINCT finding_id) FROM found) AS finding_count, (SELECT count(*) FROM e) AS evidence_count, (SELECT bit_xor({_BITS.format('id')}) FROM (SELECT DISTINCT trace_id AS id FROM found)) AS trace_hash,
      (SELECT bit_xor({_BITS.format('id')}) FROM (SELECT DISTINCT finding_id AS id FROM found)) AS finding_hash, (SELECT bit_xor({_BITS.format('id')}) FROM e) AS evidence_hash, (SELECT max(created_at) FROM found) AS created_at""",
    "completion_facts": _FACTS + " SELECT trace_id, sequence, evidence_id, span_id, actor, kind, status, tool_name, CASE WHEN kind = 'assistant_message' THEN 'final_response' WHEN mandatory THEN 'mandatory' ELSE 'goal_relevant' END AS lane, mandatory, CAST(relevance AS INT) AS relevance FROM ev",
    "first_success_after_failure": _FACTS
    + """, n AS (SELECT *, min(CASE WHEN status = 'succeeded' THEN struct_pack(p := sequence, e := evidence_id) END) OVER (PARTITION BY trace_id, family ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ev WHERE actor = 'tool')
      SELECT trace_id, sequence AS failure_sequence, evidence_id AS failure_evidence, nxt.p AS success_sequence, nxt.e AS success_evidence FROM n WHERE status = 'failed'""",
    "telemetry_diagnostics": _CALLS
    + """, d AS (SELECT CASE WHEN NOT bool_or(coalesce(attributes['agent.final.status'] IS NOT NULL, false)) THEN 'missing_final_outcome' WHEN any_value(o.final_status) IN ('incomplete', 'unknown') THEN 'non_terminal_final_outcome' END AS code FROM once x JOIN outcomes o ON o.trace_id = x.trace_id GROUP BY x.trace_id
      UNION ALL SELECT CASE status_quality WHEN 'ambiguous' THEN 'ambiguous_source_status' ELSE 'missing_source_status' END FROM calls WHERE status_quality IN ('ambiguous', 'missing') UNION ALL SELECT 'missing_invocation_fingerprint' FROM calls WHERE invocation_quality = 'missing'
      UNION ALL SELECT 'detector_inconclusive_missing_facts' FROM (""" + SQL["detector_coverage"].replace("WITH ", "WITH ", 1) + """) WHERE status = 'inconclusive')
      SELECT code, count(*) AS n FROM d WHERE code IS NOT NULL GROUP BY code""",
}
