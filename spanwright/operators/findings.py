"""What is made of findings: signature groups, rates and their comparison over two windows, evidence packets, bounded texts, candidates.

Defined results: repeated rows of a finding_id are one finding; null signatures form no group; empty tables give no rows (one-row reports: counts of 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import SEVERITIES, hash_parts, hash_text, is_label, named, rank_of, truncate_utf8

# Metadata that may stand in texts for others to read; fields that may not, by name and by words that their names hold.
PROJECTED = ["subject", "tool_name", "operation", "error_kind", "policy_id", "reason_code", "approval_outcome"]
FORBIDDEN_NAMES = ["organization_id", "project_id", "service_id", "environment_id", "deployment_id", "revision_id"]
FORBIDDEN_WORDS = ["secret", "password", "credential", "api_key", "token"]


def forbidden(field: str) -> bool:
    """Whether a field may not be written into texts for others to read."""
    low = field.lower()
    return low in FORBIDDEN_NAMES or any(w in low for w in FORBIDDEN_WORDS)


def once(findings: DataFrame) -> DataFrame:
    return findings.filter("finding_id is not null").dropDuplicates(["finding_id"])


def _folded(text: Column) -> Column:
    """60 bits of a text's hash, whose exclusive or over rows doesn't depend on their order."""
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 15), 16, 10).cast("long")


def signature_groups(findings: DataFrame) -> DataFrame:
    """One row a failure signature: group id, detectors, numbers of findings and traces, a hash of the findings' ids (``finding_hash``), worst severity, first and
    last time, recoveries (map). A signature may hold a share of all findings: its members are rows of :func:`signature_members`."""
    f = once(findings).filter("failure_signature is not null")
    counts = f.groupBy("failure_signature", "recovery").agg(F.count(F.lit(1)).alias("n")).groupBy("failure_signature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("recovery", "n")))).alias("recovery_counts"))
    traces = f.groupBy("failure_signature", "trace_id").agg(
        F.count(F.lit(1)).alias("_n"), F.collect_set("detector_id").alias("_d"), F.bit_xor(_folded(F.col("finding_id"))).alias("_x"), F.max(rank_of(F.col("severity"), SEVERITIES)).alias("_s"), F.min("created_at").alias("_lo"), F.max("created_at").alias("_hi")
    )
    g = traces.groupBy("failure_signature").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_d")))).alias("detector_ids"),
        F.sum("_n").alias("occurrence_count"),
        F.count("trace_id").alias("trace_count"),
        F.bit_xor("_x").alias("finding_hash"),
        named(F.max("_s"), SEVERITIES).alias("severity"),
        F.min("_lo").alias("first_seen_at"),
        F.max("_hi").alias("last_seen_at"),
    )
    sig = F.encode("failure_signature", "UTF-8")
    gid = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.encode(F.lit("known_signature"), "UTF-8"), F.unhex(F.lpad(F.hex(F.octet_length(sig).cast("long")), 16, "0")), sig), 256))
    return g.join(counts, "failure_signature").withColumn("group_id", gid)


def signature_members(findings: DataFrame) -> DataFrame:
    """(failure_signature, finding_id, trace_id): the members of the groups."""
    return once(findings).filter("failure_signature is not null").select("failure_signature", "finding_id", "trace_id")


def rates_by_kind(findings: DataFrame, observed: int) -> DataFrame:
    """(``kind``, ``occurrence_count``, ``affected_trace_count``, ``affected_trace_rate``): null rates if no trace was observed."""
    g = once(findings).groupBy(F.col("detector_id").alias("kind")).agg(F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct("trace_id").alias("affected_trace_count"))
    return g.withColumn("affected_trace_rate", F.col("affected_trace_count") / F.nullif(F.lit(float(observed)), F.lit(0.0)))


def novel_findings(baseline: DataFrame, candidate: DataFrame, threshold: str = "high") -> DataFrame:
    """The candidate's findings of at least the threshold's severity whose signature the baseline doesn't have."""
    severe = once(candidate).filter(rank_of(F.col("severity"), SEVERITIES) >= SEVERITIES.index(threshold))
    return severe.join(baseline.select("failure_signature").distinct(), "failure_signature", "left_anti")


def recurrence(baseline: DataFrame, candidate: DataFrame, targets: DataFrame, observed: tuple[int, int], basis: tuple[str, str] = ("exact", "exact"), threshold: str = "high") -> DataFrame:
    """One row: occurrences and affected traces of the target signatures (``failure_signature``) in two windows, rates, their difference and ratio, severe novelties, gaps in the evidence."""
    t = targets.select("failure_signature").distinct()
    b = once(baseline).join(t, "failure_signature", "left_semi").select(F.lit(0).alias("w"), "trace_id")
    c = once(candidate).join(t, "failure_signature", "left_semi").select(F.lit(1).alias("w"), "trace_id")
    g = b.unionByName(c).agg(
        *[F.count_if(F.col("w") == i).alias(f"{n}_occurrence_count") for i, n in enumerate(("baseline", "candidate"))], *[F.count_distinct(F.when(F.col("w") == i, F.col("trace_id"))).alias(f"{n}_affected_trace_count") for i, n in enumerate(("baseline", "candidate"))]
    )
    rates = [F.col(f"{n}_affected_trace_count") / F.nullif(F.lit(float(observed[i])), F.lit(0.0)) for i, n in enumerate(("baseline", "candidate"))]
    gaps = [f"{n}_window_has_no_observed_traces" for i, n in enumerate(("baseline", "candidate")) if observed[i] == 0] + [f"{n}_population_basis_unknown" for i, n in enumerate(("baseline", "candidate")) if basis[i] == "unknown"]
    # Their ids are the rows of novel_findings.
    new = novel_findings(baseline, candidate, threshold).agg(F.count(F.lit(1)).alias("severe_novel_count"))
    out = g.withColumns({"baseline_recurrence_rate": rates[0], "candidate_recurrence_rate": rates[1]})
    out = out.withColumns({"recurrence_rate_delta": F.col("candidate_recurrence_rate") - F.col("baseline_recurrence_rate"), "recurrence_rate_ratio": F.col("candidate_recurrence_rate") / F.nullif(F.col("baseline_recurrence_rate"), F.lit(0.0))})
    return out.crossJoin(new).withColumns({"evidence_complete": F.lit(not gaps), "evidence_gaps": F.array(*[F.lit(x) for x in gaps]).cast("array<string>")})  # one row each


def packet_members(findings: DataFrame) -> DataFrame:
    """(``kind``, ``id``): the distinct traces, findings and evidences of a run."""
    f = once(findings)
    of = lambda kind, c: f.select(F.lit(kind).alias("kind"), c.alias("id"))
    return of("trace", F.col("trace_id")).unionByName(of("finding", F.col("finding_id"))).unionByName(of("evidence", F.explode("evidence"))).filter("id is not null").distinct()


def evidence_packet(findings: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row over a run: numbers and hashes of its traces, findings and evidences, detector versions, gaps, last time, content hash and id.

    What it holds are the rows of :func:`packet_members`; the content hash is one over their counts and order-free hashes.
    """
    kinds = ["trace", "finding", "evidence"]
    m = packet_members(findings)
    own = m.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds], *[F.coalesce(F.bit_xor(F.when(F.col("kind") == k, _folded(F.col("id")))), F.lit(0)).alias(f"{k}_hash") for k in kinds])
    v = findings.select("detector_id", "detector_version").distinct().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector_id", "detector_version")))).alias("detector_versions"))
    g = findings.agg(F.max("created_at").alias("created_at"))
    gaps = diagnostics.select("code").distinct().agg(F.array_sort(F.collect_list("code")).alias("telemetry_gaps")) if diagnostics is not None else g.select(F.array().cast("array<string>").alias("telemetry_gaps"))
    row = own.crossJoin(v).crossJoin(g).crossJoin(gaps)  # one row each
    versions = F.array_join(F.transform(F.array_sort(F.map_entries("detector_versions")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    row = row.withColumn("content_hash", hash_text(F.concat_ws("|", *[F.col(f"{k}_{x}").cast("string") for k in kinds for x in ("count", "hash")], versions, F.array_join("telemetry_gaps", ","))))
    return row.withColumn("packet_id", hash_parts(F.lit("evidence_packet"), F.col("content_hash")))


def projections(findings: DataFrame, context: DataFrame | None = None, fields: list[str] | None = None, most: int = 4096, redact: object = None) -> DataFrame:
    """(finding_id, trace_id, ``text``, ``text_hash``, ``truncated``, ``included_fields``): a bounded text of allowed facts, sorted ``name: value`` lines.

    ``context`` (trace_id, metadata) fills fields that the finding lacks. ``redact``: Column -> Column on values; by default other than bounded
    labels are left out. Forbidden fields are never written.
    """
    redact = redact or (lambda v: F.when(is_label(v), v))
    f = once(findings)
    if context is not None:
        f = f.join(context.groupBy("trace_id").agg(F.first("metadata", ignorenulls=True).alias("_ctx")), "trace_id", "left")
    else:
        f = f.withColumn("_ctx", F.create_map().cast("map<string,string>"))
    pairs = [F.struct(F.lit(n).alias("n"), F.col(c).cast("string").alias("v")) for n, c in (("detector", "detector_id"), ("kind", "detector_id"), ("severity", "severity"), ("recovery", "recovery"))]
    for n in fields or PROJECTED:
        if not forbidden(n):
            pairs.append(F.struct(F.lit(n).alias("n"), redact(F.coalesce(F.try_element_at("metadata", F.lit(n)), F.try_element_at(F.col("_ctx"), F.lit(n)))).alias("v")))
    kept = F.array_sort(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    full = F.array_join(F.transform(kept, lambda p: F.concat(p["n"], F.lit(": "), p["v"])), "\n")
    f = f.select("finding_id", "trace_id", full.alias("_full"), F.transform(kept, lambda p: p["n"]).alias("included_fields"))
    f = f.withColumn("text", truncate_utf8(F.col("_full"), most))
    return f.select("finding_id", "trace_id", "text", hash_text(F.col("text")).alias("text_hash"), (F.octet_length("_full") > most).alias("truncated"), "included_fields")


def projection_cases(p: DataFrame) -> DataFrame:
    """Evaluation cases whose input is the projected text."""
    return p.select(F.col("finding_id").alias("id"), "trace_id", F.col("text").alias("input"), F.lit(None).cast("string").alias("actual_output"), F.lit(None).cast("string").alias("expected_output"), F.lit(None).cast("string").alias("rubric"), F.create_map(F.lit("source"), F.lit("finding_projection"), F.lit("finding_id"), F.col("finding_id"), F.lit("text_hash"), F.col("text_hash")).alias("metadata"))


def candidates(findings: DataFrame, name: str = "behavior_finding", version: str = "1") -> DataFrame:
    """Evaluation candidates, one a finding: what is expected of a fix, a hash of that definition, an id, status ``candidate``."""
    f = once(findings)
    expect = F.array(F.concat(F.lit("not:"), F.col("failure_signature")))
    f = f.withColumn("expectations", expect)
    definition = F.to_json(F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), "failure_signature", "severity", "expectations"), {"ignoreNullFields": "false"})
    f = f.withColumn("definition_hash", hash_text(definition))
    return f.select(hash_parts(F.col("finding_id"), F.lit(name), F.lit(version), F.col("definition_hash")).alias("candidate_id"), "finding_id", "trace_id", "failure_signature", "severity", "expectations", "definition_hash", F.lit("candidate").alias("status"))


def with_traces(findings: DataFrame, traces: DataFrame, how: str = "inner") -> DataFrame:
    """Findings beside their trace's metadata; those of unknown traces are dropped (``inner``) or kept (``left``)."""
    t = traces.groupBy(F.col("id").alias("trace_id")).agg(F.first("metadata", ignorenulls=True).alias("trace_metadata"))
    return findings.join(t, "trace_id", how)


def severity_at_least(severity: Column, threshold: str) -> Column:
    return rank_of(severity, SEVERITIES) >= SEVERITIES.index(threshold)
