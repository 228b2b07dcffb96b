"""python -m spanwright.cli VERB ...: the operators on files.

extract, detect, grade, validate, calibrate, cluster-assign, discover, report, verify-findings, compare-recurrence, export. Folders of part files are written;
reports are one indented document. ``validate`` and ``verify-findings`` write first and then exit with 1 if there are errors.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from spanwright.operators import cluster, detectors, evaluate, extract, findings, verify
from spanwright.session import local_session
from spanwright.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanwright")
    v = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *needs: str, **extra: object) -> argparse.ArgumentParser:
        s = v.add_parser(name)
        for n in needs:
            s.add_argument(f"--{n}", required=True)
        return s

    verb("extract", "traces", "out").add_argument("--extractor", choices=["openinference", "simple"], default="openinference")
    d = verb("detect", "traces", "out")
    d.add_argument("--mappings")
    d.add_argument("--repeated-failures", type=int, default=3)
    d.add_argument("--loop-calls", type=int, default=4)
    d.add_argument("--tool-calls", type=int, default=25)
    d.add_argument("--duration-ms", type=int, default=60_000)
    for name in ("groups", "projections", "candidates", "packet"):
        d.add_argument(f"--{name}")
    g = verb("grade", "cases", "out")
    g.add_argument("--contains")
    x = verb("validate", "cases", "out")
    x.add_argument("--results")
    x.add_argument("--draft", action="store_true")
    c = verb("calibrate", "results", "ratings", "out")
    c.add_argument("--threshold", type=int, default=3)
    c.add_argument("--apply")
    verb("cluster-assign", "cases", "clusters", "out")
    k = verb("discover", "embeddings", "out", "assignments")
    k.add_argument("--k", type=int, required=True)
    r = verb("report", "results", "out")
    r.add_argument("--clusters")
    f = verb("verify-findings", "baseline", "candidate", "targets", "out")
    f.add_argument("--severe", default="high")
    m = verb("compare-recurrence", "baseline", "candidate", "targets", "out")
    m.add_argument("--observed", type=int, nargs=2, required=True)
    e = verb("export", "cases", "out")
    e.add_argument("--format", choices=["csv", "openai", "promptfoo"], required=True)
    return p


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = local_session(app="spanwright-cli")
    jsonl = lambda path, schema: files.read_jsonl(spark, path, schema)
    if a.verb == "extract":
        spans, traces = files.read_traces(spark, a.traces)
        files.write_jsonl(extract.simple_cases(spans, True) if a.extractor == "simple" else extract.openinference_cases(spans, traces, True), a.out)
    elif a.verb == "detect":
        spans, traces = files.read_traces(spark, a.traces)
        maps = jsonl(a.mappings, "tool_name string, operation string, effect string, retry_safety string, requirement string") if a.mappings else None
        limits = detectors.Limits(a.repeated_failures, 8, a.loop_calls, a.tool_calls, a.duration_ms)
        found = detectors.detect(detectors.Facts.of(spans, maps), None, limits).persist()
        files.write_jsonl(found, a.out)
        if a.groups:
            files.write_jsonl(findings.signature_groups(found), a.groups)
        if a.projections:
            files.write_jsonl(findings.projections(found, traces.withColumnRenamed("id", "trace_id")), a.projections)
        if a.candidates:
            files.write_jsonl(findings.candidates(found), a.candidates)
        if a.packet:
            files.write_pretty(findings.evidence_packet(found), a.packet)
            files.write_jsonl(findings.packet_members(found), f"{a.packet}.members")
    elif a.verb == "grade":
        cases = jsonl(a.cases, files.CASE)
        parts = [evaluate.non_empty_output(cases), evaluate.exact_match(cases)] + ([evaluate.contains(cases, a.contains)] if a.contains else [])
        files.write_jsonl(evaluate.run_of(*parts), a.out)
    elif a.verb == "validate":
        cases = jsonl(a.cases, files.CASE)
        issues = verify.validate_cases(cases, a.draft)
        if a.results:
            issues = issues.unionByName(verify.validate_results(jsonl(a.results, files.RESULT), cases))
        files.write_jsonl(issues, a.out)
        return int(not issues.filter("severity = 'error'").isEmpty())
    elif a.verb == "calibrate":
        results = jsonl(a.results, files.RESULT)
        bins, model = evaluate.fit_calibration(results, jsonl(a.ratings, files.RATING), a.threshold)
        files.write_pretty(model.crossJoin(bins.agg(F.array_sort(F.collect_list(F.struct("bin_key", "score", "n", "mean_human", "pass_rate"))).alias("bins"))), a.out)  # one row each
        if a.apply:
            files.write_jsonl(evaluate.calibrated(results, bins), a.apply)
    elif a.verb == "cluster-assign":
        files.write_jsonl(cluster.assign_by_rules(jsonl(a.cases, files.CASE), jsonl(a.clusters, files.CLUSTER)), a.out)
    elif a.verb == "discover":
        model, assigned = cluster.discover(jsonl(a.embeddings, "case_id string, vector array<float>"), "case_id", "vector", a.k)
        files.write_jsonl(model, a.out)
        files.write_jsonl(assigned, a.assignments)
    elif a.verb == "report":
        results = jsonl(a.results, files.RESULT)
        files.write_jsonl(evaluate.report(results, jsonl(a.clusters, files.CLUSTER) if a.clusters else None), a.out)
    elif a.verb in ("verify-findings", "compare-recurrence"):
        from spanwright.streaming.runner import FINDINGS

        b, c = jsonl(a.baseline, FINDINGS), jsonl(a.candidate, FINDINGS)
        t = jsonl(a.targets, "failure_signature string")
        if a.verb == "compare-recurrence":
            files.write_pretty(findings.recurrence(b, c, t, tuple(a.observed)), a.out)
        else:
            gate = verify.finding_gate(b, c, t, a.severe)
            files.write_pretty(gate, a.out)
            return int(not gate.first()["passed"])
    elif a.verb == "export":
        cases = jsonl(a.cases, files.CASE)
        if a.format == "csv":
            files.write_cases_csv(cases, a.out)
        elif a.format == "openai":
            files.write_jsonl(files.openai_eval_rows(cases), a.out)
        else:
            files.write_promptfoo(cases, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
