"""Comparison of a baseline and a candidate: paired results, gates on findings, results and budgets; validation of artifacts.

Results are paired by (case_id, evaluator_name, evaluator_version), null versions being equal. Defined results: of repeated rows of a key the
first by ``ord`` (if there) counts and the key is listed as duplicate; empty tables give gates that don't pass for want of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import trim_u
from spanwright.operators.findings import novel_findings, once

KEY = ["case_id", "evaluator_name", "evaluator_version"]


def _keyed(results: DataFrame, side: str) -> DataFrame:
    version = F.col("evaluator_version") if "evaluator_version" in results.columns else F.lit(None).cast("string")
    by = F.col("ord") if "ord" in results.columns else F.lit(0)
    r = results.withColumn("evaluator_version", version)
    ok = F.coalesce(F.col("normalized_score").between(0, 1), F.lit(False))
    return r.groupBy(*KEY).agg(F.min_by(F.struct("normalized_score", "passed"), F.struct(by, F.struct("normalized_score", "passed"))).alias(f"_{side}"), F.count(F.lit(1)).alias(f"{side}_rows"), F.min(ok).alias(f"{side}_valid"))


def paired_results(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """A full outer join by key: ``pairing`` (paired, missing_candidate, unexpected_candidate), scores, passes, delta, row counts, score validity."""
    b, c = _keyed(baseline, "baseline"), _keyed(candidate, "candidate")
    # null-safe keys as ordinary ones: a hash join needs plain equality
    safe = lambda df: df.withColumn("_v", F.coalesce(F.concat(F.lit("v"), F.col("evaluator_version")), F.lit("-")))
    j = safe(b).withColumnRenamed("evaluator_version", "_bv").join(safe(c).withColumnRenamed("evaluator_version", "_cv"), ["case_id", "evaluator_name", "_v"], "full_outer")
    pairing = F.when(F.col("_candidate").isNull(), "missing_candidate").when(F.col("_baseline").isNull(), "unexpected_candidate").otherwise("paired")
    return j.select(
        "case_id",
        "evaluator_name",
        F.coalesce("_bv", "_cv").alias("evaluator_version"),
        pairing.alias("pairing"),
        F.col("_baseline.normalized_score").alias("baseline_score"),
        F.col("_candidate.normalized_score").alias("candidate_score"),
        F.col("_baseline.passed").alias("baseline_passed"),
        F.col("_candidate.passed").alias("candidate_passed"),
        (F.col("_candidate.normalized_score") - F.col("_baseline.normalized_score")).alias("score_delta"),
        F.coalesce("baseline_rows", F.lit(0)).alias("baseline_rows"),
        F.coalesce("candidate_rows", F.lit(0)).alias("candidate_rows"),
        (F.coalesce("baseline_valid", F.lit(True)) & F.coalesce("candidate_valid", F.lit(True))).alias("scores_valid"),
    )


_CATEGORIES = {
    "missing_candidate_results": "pairing = 'missing_candidate'",
    "unexpected_candidate_results": "pairing = 'unexpected_candidate'",
    "failed_candidate_results": "pairing = 'paired' and not candidate_passed",
    "unversioned_results": "evaluator_version is null",
    "invalid_identity_results": "case_id is null or trim(case_id) = '' or evaluator_name is null or trim(evaluator_name) = ''",
    "invalid_score_results": "not scores_valid",
    "duplicate_baseline_results": "baseline_rows > 1",
    "duplicate_candidate_results": "candidate_rows > 1",
}


def case_gates(paired: DataFrame) -> DataFrame:
    """One row a case: counts of each kind of failure and ``passed``."""
    g = paired.groupBy("case_id").agg(F.count_if(F.col("pairing") == "paired").alias("paired_result_count"), F.count_if(F.col("pairing") != "unexpected_candidate").alias("_b"), *[F.count_if(F.expr(e)).alias(n) for n, e in _CATEGORIES.items()])
    ok = F.col("_b") > 0
    for n in _CATEGORIES:
        ok = ok & (F.col(n) == 0)
    return g.withColumn("passed", ok).drop("_b")


def suite_gate(paired: DataFrame, suite: DataFrame, max_drop: float = 0.0, most_regressions: int = 0) -> DataFrame:
    """One row over the suite's cases (case_id): failures by kind, cases without baseline, regressions, the largest score drop, ``passed``."""
    p = paired.join(suite.select("case_id").distinct(), "case_id", "left_semi")
    regressed = (F.col("pairing") == "paired") & F.col("baseline_passed") & ~F.col("candidate_passed")
    kinds = {k: e for k, e in _CATEGORIES.items() if k != "failed_candidate_results"}
    g = p.agg(
        F.count_if(F.col("pairing") == "paired").alias("paired_result_count"), *[F.count_if(F.expr(e)).alias(n) for n, e in kinds.items()], F.count_if(regressed).alias("regressed_results"), F.coalesce(F.max(-F.col("score_delta")), F.lit(0.0)).alias("largest_drop")
    )
    missing = suite.select("case_id").distinct().join(p.filter("pairing <> 'unexpected_candidate'").select("case_id"), "case_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_baseline_cases"))
    row = g.crossJoin(missing)  # one row each
    ok = (F.col("paired_result_count") > 0) & (F.col("missing_baseline_cases") == 0) & (F.col("regressed_results") <= most_regressions) & (F.col("largest_drop") <= max_drop)
    for n in kinds:
        ok = ok & (F.col(n) == 0)
    return row.withColumn("passed", ok)


def finding_gate(baseline: DataFrame, candidate: DataFrame, targets: DataFrame, threshold: str = "high") -> DataFrame:
    """One row: all target signatures reproduced by the baseline, none emitted by the candidate, no severe novelty; ``passed`` if all hold."""
    t = targets.select("failure_signature").distinct()
    n = t.agg(F.count(F.lit(1)).alias("target_count"))
    b = t.join(once(baseline).select("failure_signature").distinct(), "failure_signature", "left_semi").agg(F.count(F.lit(1)).alias("_b"))
    c = t.join(once(candidate).select("failure_signature").distinct(), "failure_signature", "left_semi").agg(F.array_sort(F.collect_list("failure_signature")).alias("recurring_target_signatures"))
    s = novel_findings(baseline, candidate, threshold).agg(F.count(F.lit(1)).alias("severe_novel_count"))
    row = n.crossJoin(b).crossJoin(c).crossJoin(s)  # one row each
    row = row.withColumns({"baseline_reproduced": (F.col("target_count") > 0) & (F.col("_b") == F.col("target_count")), "candidate_resolved": F.size("recurring_target_signatures") == 0, "no_severe_novel_findings": F.col("severe_novel_count") == 0})
    return row.withColumn("passed", F.col("baseline_reproduced") & F.col("candidate_resolved") & F.col("no_severe_novel_findings")).drop("_b")


def budget_gate(baseline: dict[str, int], candidate: dict[str, int], most_increase: dict[str, int]) -> dict:
    """Increases of measures (tool_calls, duration_ms, cost, ...) that can't fall below 0, and whether each keeps to its bound."""
    up = {k: max(0, candidate.get(k, 0) - baseline.get(k, 0)) for k in {*baseline, *candidate}}
    return {"increases": up, "passed": all(up[k] <= most_increase.get(k, up[k]) for k in up)}


#: The parts of a remediation check, in their order.
REMEDIATION = ["findings_resolved", "no_severe_novel_findings", "incident_passed", "suite_passed", "budget_held"]


def usage(findings_or_calls: DataFrame) -> DataFrame:
    """One row of measures over calls (``duration_ms``): ``tool_calls``, ``duration_ms``, ``traces``."""
    c = findings_or_calls
    return c.agg(F.count(F.lit(1)).alias("tool_calls"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.count_distinct("trace_id").alias("traces"))


def budget_gate_rows(baseline: DataFrame, candidate: DataFrame, most_increase: dict[str, int], measures: list[str]) -> DataFrame:
    """(``measure``, ``baseline``, ``candidate``, ``increase``, ``most``, ``passed``), a row a measure, from one-row tables of measures. Increases can't fall below 0; a measure without a bound passes."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(m), F.lit(0)).cast("long").alias(name)) for m in measures])).alias("x")).select("x.*")
    most = F.coalesce(*[F.when(F.col("measure") == k, F.lit(v).cast("long")) for k, v in most_increase.items()], F.lit(None).cast("long"))
    j = long(baseline, "baseline").join(long(candidate, "candidate"), "measure").withColumn("increase", F.greatest(F.col("candidate") - F.col("baseline"), F.lit(0)))
    return j.withColumn("most", most).withColumn("passed", F.coalesce(F.col("increase") <= F.col("most"), F.lit(True)))


def remediation(findings: DataFrame, incident: DataFrame | None = None, suite: DataFrame | None = None, budget: DataFrame | None = None) -> DataFrame:
    """(``gate``, ``passed``) of each part that was checked and of the whole (``remediation``), which passes if all parts do.

    ``findings`` from :func:`finding_gate`, ``incident`` and ``suite`` one-row gates with ``passed``, ``budget`` from :func:`budget_gate_rows`.
    """
    row = lambda df, name, c: df.select(F.lit(name).alias("gate"), c.alias("passed"))
    parts = [row(findings, REMEDIATION[0], F.col("baseline_reproduced") & F.col("candidate_resolved")), row(findings, REMEDIATION[1], F.col("no_severe_novel_findings"))]
    parts += [row(df, name, F.col("passed")) for df, name in ((incident, REMEDIATION[2]), (suite, REMEDIATION[3])) if df is not None]
    if budget is not None:
        parts.append(budget.agg(F.coalesce(F.min("passed"), F.lit(True)).alias("_p")).select(F.lit(REMEDIATION[4]).alias("gate"), F.col("_p").alias("passed")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.unionByName(out.agg(F.min(F.coalesce("passed", F.lit(False))).alias("_p")).select(F.lit("remediation").alias("gate"), F.col("_p").alias("passed")))


# --- validation --------------------------------------------------------------------------------------------------------------


def _blank(c: str) -> Column:
    return F.coalesce(trim_u(F.col(c)) == "", F.lit(True))


def _issues(df: DataFrame, code: str, where: Column, severity: str = "error", case: str = "id", trace: str | None = "trace_id") -> DataFrame:
    t = F.col(trace) if trace else F.lit(None).cast("string")
    return df.filter(where).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(case).alias("case_id"), t.alias("trace_id"))


def _repeated(df: DataFrame, keys: list[str], code: str, case: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumn("_x", F.explode(F.sequence(F.lit(2).cast("long"), F.col("_n"))))
    return g.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), F.col(case).alias("case_id"), F.lit(None).cast("string").alias("trace_id"))


def validate_cases(cases: DataFrame, draft: bool = False) -> DataFrame:
    """Issues (``severity``, ``code``, ``case_id``, ``trace_id``) of cases; a missing answer is only a warning in drafts. Each repetition of an id is one issue."""
    out = _issues(cases, "missing_case_id", _blank("id")).unionByName(_repeated(cases.filter(~_blank("id")), ["id"], "duplicate_case_id", "id"))
    out = out.unionByName(_issues(cases, "missing_trace_id", _blank("trace_id"))).unionByName(_issues(cases, "missing_input", _blank("input")))
    return out.unionByName(_issues(cases, "missing_actual_output", _blank("actual_output"), "warning" if draft else "error"))


def validate_results(results: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Issues of results: blank names, repeated (case, evaluator), scores off their scale or range, unknown cases."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    raw = F.col("raw_score")
    on = F.when(F.col("score_scale") == "four_point", raw.between(1, 4)).when(F.col("score_scale").isin("binary", "unit"), raw.between(0, 1)).otherwise(F.lit(False))
    of = lambda code, where: _issues(results, code, where, case="case_id")
    out = of("missing_case_id", _blank("case_id")).unionByName(of("missing_trace_id", _blank("trace_id"))).unionByName(of("missing_evaluator_name", _blank("evaluator_name")))
    out = out.unionByName(_repeated(results, ["case_id", "evaluator_name"], "duplicate_result", "case_id")).unionByName(of("invalid_raw_score", bad(on & ~F.isnan(raw))))
    out = out.unionByName(of("invalid_normalized_score", bad(F.col("normalized_score").between(0, 1)))).unionByName(of("invalid_calibrated_score", F.col("calibrated_score").isNotNull() & ~F.col("calibrated_score").between(0, 1)))
    if cases is not None:
        out = out.unionByName(_issues(results.join(cases.select(F.col("id").alias("case_id")).distinct(), "case_id", "left_anti"), "unknown_result_case", F.lit(True), case="case_id"))
    return out


def validate_embeddings(embeddings: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Issues of embeddings (case_id, vector): repeated, empty or not finite, mixed dimensions, cases without one, unknown cases."""
    v = F.col("vector")
    broken = v.isNull() | (F.size(v) < 1) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    of = lambda df, code, where: _issues(df, code, where, case="case_id", trace=None)
    out = of(embeddings, "invalid_embedding", F.coalesce(broken, F.lit(True))).unionByName(_repeated(embeddings, ["case_id"], "duplicate_embedding", "case_id"))
    most = embeddings.groupBy(F.size("vector").alias("_d")).count().agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(most.filter("n > 1").select(F.lit("error").alias("severity"), F.lit("mixed_embedding").alias("code"), F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("string").alias("trace_id")))
    if cases is not None:
        ids = cases.select(F.col("id").alias("case_id")).distinct()
        out = out.unionByName(of(ids.join(embeddings.select("case_id"), "case_id", "left_anti"), "missing_embedding", F.lit(True))).unionByName(of(embeddings.join(ids, "case_id", "left_anti"), "unknown_embedding_case", F.lit(True)))
    return out


def validate_assignments(assignments: DataFrame, cases: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """Issues of assignments: repeated cases, blank clusters, confidence outside 0..1, negative distances, unknown cases and clusters."""
    of = lambda df, code, where: _issues(df, code, where, case="case_id", trace=None)
    out = _repeated(assignments, ["case_id"], "duplicate_cluster_assignment", "case_id").unionByName(of(assignments, "missing_cluster_id", _blank("cluster_id")))
    out = out.unionByName(of(assignments, "invalid_cluster_confidence", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))))
    if "distance" in assignments.columns:
        out = out.unionByName(of(assignments, "invalid_cluster_distance", F.col("distance").isNotNull() & ((F.col("distance") < 0) | F.isnan("distance"))))
    if cases is not None:
        out = out.unionByName(of(assignments.join(cases.select(F.col("id").alias("case_id")).distinct(), "case_id", "left_anti"), "unknown_assignment_case", F.lit(True)))
    if clusters is not None:
        out = out.unionByName(of(assignments.filter("cluster_id <> 'unclustered'").join(clusters.select(F.col("id").alias("cluster_id")).distinct(), "cluster_id", "left_anti"), "unknown_assignment_cluster", F.lit(True)))
    return out


def report(issues: DataFrame) -> DataFrame:
    """(``severity``, ``code``, ``n``)."""
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
