"""Behaviour facts from spans: tool calls, policy decisions, final outcomes and claims, one row each.

All facts are long tables keyed by trace, so that no trace has to fit into a row or a task. Order within a trace is ``pos``.
Attribute look-ups take the first key of a list that holds a value.

Defined results: repeated rows of one (trace_id, id) are one span (the first ingested, if ``ingested_at`` is there); rows with a null
trace_id or id don't count; null attributes are an empty map.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.attributes import alias_value, as_bool, attr, attr_bool, attr_count, attr_number, resolved_kind
from spanwright.functions.instants import instant_us
from spanwright.functions.text import ascii_lower, canonical_json, hash_text, is_identity, is_label
from spanwright.operators.slices import LIMIT, large_keys, running
from spanwright.session import Scratch

# Attribute keys, in the order of their precedence, and spellings of values.
KEYS = {
    "tool_name": ["gen_ai.tool.name", "tool.name", "tool_name"],
    "operation": ["gen_ai.operation.name", "agent.operation", "tool.operation", "operation", "operation.name"],
    "effect": ["agent.operation.effect", "tool.effect", "operation.effect"],
    "retry_safety": ["agent.operation.retry_safety", "tool.retry_safety", "operation.retry_safety"],
    "requirement": ["agent.tool.requirement", "tool.requirement", "operation.requirement"],
    "approval_required": ["agent.approval.required", "tool.approval.required"],
    "approval_outcome": ["agent.approval.outcome", "approval.outcome", "approval_outcome"],
    "result_success": ["tool.result.success", "tool_result.success", "gen_ai.tool.result.success", "result.success", "result.ok"],
    "status": ["agent.tool.status", "tool.status", "gen_ai.tool.status", "execution.status"],
    "timeout": ["tool.timeout", "execution.timeout"],
    "cancelled": ["tool.cancelled", "execution.cancelled"],
    "protocol": ["http.status_code", "http.response.status_code", "rpc.status_code", "protocol.status_code"],
    "call_id": ["gen_ai.tool.call.id", "tool.call.id", "tool_call_id", "call_id"],
    "attempt": ["agent.tool.attempt", "tool.attempt", "attempt"],
    "duration_ms": ["duration_ms", "tool.duration_ms", "gen_ai.tool.duration_ms"],
    "duration_s": ["gen_ai.execute_tool.duration", "tool.duration", "execution.duration"],
    "error_code": ["error.code", "tool.error.code", "exception.type", "http.status_code"],
    "error_kind": ["error.type", "tool.error.kind", "exception.type"],
    "error_message": ["exception.message", "error.message", "tool.error.message"],
    "retryable": ["error.retryable", "tool.error.retryable"],
    "observation": ["agent.state.observation", "tool.state.observation", "state.observation"],
    "predicate": ["agent.state.predicate", "tool.state.predicate", "state.predicate"],
    "artifact": ["agent.state.artifact.id", "tool.state.artifact.id", "state.artifact.id"],
    "state_delta": ["state_delta", "agent.state_delta", "state.delta"],
    "invocation": ["gen_ai.tool.call.arguments", "tool.arguments", "tool.parameters", "input.value", "input"],
    "result": ["gen_ai.tool.call.result", "tool.result", "output.value", "output"],
    "policy_outcome": ["agent.policy.outcome", "policy.decision.outcome", "policy.outcome", "guardrail.outcome"],
    "decision_id": ["policy.decision.id", "decision_id"],
    "policy_id": ["policy.id", "policy.version", "policy_version"],
    "policy_action": ["policy.action", "action", "tool_name"],
    "policy_reason": ["policy.reason_code", "reason_code"],
    "final_status": ["agent.final.status", "final.status"],
    "escalation": ["agent.escalation.status", "final.escalation.status"],
    "claims": ["agent.outcome.claims", "final.outcome.claims"],
    "claim_status": ["agent.outcome.claim.status", "final.outcome.claim.status"],
    "claim_operation": ["agent.outcome.claim.operation", "final.outcome.claim.operation"],
    "claim_call_id": ["agent.outcome.claim.call_id", "final.outcome.claim.call_id"],
}
EFFECTS = {"read_only": ["read_only", "read-only", "readonly"], "mutating": ["mutating", "mutation"], "verifying": ["verifying", "verification"], "compensating": ["compensating", "compensation"], "escalating": ["escalating", "escalation"]}
RETRY_SAFETY = {"idempotent": ["idempotent"], "non_idempotent": ["non_idempotent", "non-idempotent", "nonidempotent"]}
REQUIREMENTS = {"required": ["required"], "optional": ["optional"]}
APPROVALS = {"approved": ["approved", "allow", "allowed"], "denied": ["denied", "deny", "rejected"], "cancelled": ["cancelled", "canceled"], "not_requested": ["not_requested", "not-required", "not_required"]}
OBSERVATIONS = {"verified_changed": ["verified_changed", "verified-changed"], "verified_unchanged": ["verified_unchanged", "verified-unchanged"], "unverified": ["unverified"], "ambiguous": ["ambiguous"], "conflicting": ["conflicting"]}
POLICY_OUTCOMES = {"allowed": ["allow", "allowed", "approve", "approved"], "denied": ["deny", "denied", "disallow", "disallowed", "blocked"], "required": ["require", "required"]}
FINAL_STATUSES = {"completed": ["complete", "completed"], "failed": ["failure", "failed", "error"], "safely_refused": ["safely_refused", "safe_refusal"], "escalated": ["escalated", "escalation"], "incomplete": ["incomplete", "missing"], "unknown": ["unknown", "uncertain"]}
ESCALATIONS = {"not_required": ["not_required", "not-required"], "required_and_performed": ["required_and_performed", "required-performed"], "required_and_missing": ["required_and_missing", "required-missing"]}
CLAIM_STATUSES = {"succeeded": ["success", "succeeded", "completed"], "failed": ["failure", "failed", "error"], "not_completed": ["not_completed", "not-completed"], "state_unknown": ["state_unknown", "state-unknown", "unknown"]}
FACT_KEYS = "gen_ai.operation.name gen_ai.tool.name gen_ai.tool.status agent.operation agent.operation.effect agent.operation.retry_safety agent.tool.requirement agent.tool.status agent.approval.required agent.approval.outcome agent.state.observation agent.final.status final.status agent.escalation.status final.escalation.status agent.outcome.claim.status final.outcome.claim.status tool.status tool.result.success tool.timeout tool.cancelled tool.operation tool.effect tool.retry_safety tool.requirement tool.approval.required tool.approval.outcome tool.state.observation operation operation.name operation.effect operation.retry_safety operation.requirement execution.status execution.timeout error.type error.code error.retryable tool.error.kind tool.error.code tool.error.retryable exception.type exception.escaped http.status_code rpc.status_code result.success result.ok policy.outcome guardrail.outcome".split()
FACT_CHARS = 256
FAILURES = ["failed", "timed_out", "cancelled"]
ERROR_WORDS = [("rate_limited", ["rate limit", "429"]), ("permission_denied", ["denied", "forbidden", "unauthorized"]), ("invalid_request", ["invalid", "validation"]), ("network", ["network", "connection"])]


def spans_once(spans: DataFrame, *columns: str) -> DataFrame:
    """One row for each (trace_id, id), with the named columns of the row that was ingested first."""
    rows = spans.filter(F.col("trace_id").isNotNull() & F.col("id").isNotNull())
    columns = tuple(c for c in columns if c not in ("trace_id", "id"))
    when = F.struct(F.col("ingested_at").isNull(), "ingested_at") if "ingested_at" in spans.columns else F.struct(F.lit(0))
    picked = rows.groupBy("trace_id", "id").agg(F.min_by(F.struct(*columns), when).alias("_s"))
    return picked.select("trace_id", "id", *[F.col(f"_s.{c}").alias(c) for c in columns])


def _attr(name: str) -> Column:
    return attr(F.col("attributes"), *KEYS[name])


def _contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def error_kind_of_message(message: Column) -> Column:
    low = ascii_lower(F.coalesce(message, F.lit("")))
    out = F.lit("tool_error")
    for kind, words in reversed(ERROR_WORDS):
        out = F.when(_contains_any(low, words), kind).otherwise(out)
    return out


def _fingerprint(keys: list[str], body: str) -> tuple[Column, Column]:
    """(hash, quality) of a call's input or output: from the attributes that hold it, else from the text."""
    present = F.array_compact(F.array(*[F.when(F.try_element_at(F.col("attributes"), F.lit(k)).isNotNull(), F.struct(F.lit(k).alias("key"), F.try_element_at(F.col("attributes"), F.lit(k)).alias("value"))) for k in keys]))
    text = F.when(F.size(present) > 0, F.to_json(present)).otherwise(F.coalesce(canonical_json(F.col(body)), F.col(body)))
    return F.when(text.isNotNull(), hash_text(text)), F.when(text.isNotNull(), F.lit("derived")).otherwise(F.lit("missing"))


@dataclass
class Base:
    """All that facts are made of, one row a span: ``spans`` (trace_id, id, pos, ended_at, ``_root`` and ``_decision``, structs that are null for spans that are none,
    ``_cover`` flags) and ``calls`` (the tool calls, before their numbers). With texts also ``_io``: bounded summaries of input and output, and what a call says of itself in bounded facts."""

    spans: DataFrame
    calls: DataFrame

    def kept(self) -> Base:
        """Written to the shared folder, both tables side by side."""
        with ThreadPoolExecutor(2) as pool:
            return Base(*pool.map(lambda df: Scratch(df.sparkSession, "base").keep(df), (self.spans, self.calls)))


def _completed(spans: DataFrame) -> DataFrame:
    s = spans.filter(F.col("trace_id").isNotNull() & F.col("id").isNotNull())
    for c in ("parent_id", "input", "output", "error", "started_at", "ended_at", "source_status"):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast("string"))
    for c in ("start_time_unix_nano", "end_time_unix_nano", "duration_nano"):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast("long"))
    s = s.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    return s.withColumns({"_kind": resolved_kind(F.col("kind"), F.col("attributes")), "_when": F.struct(F.col("ingested_at").isNull(), "ingested_at") if "ingested_at" in s.columns else F.struct(F.lit(0))})


def _first(s: DataFrame) -> DataFrame:
    """One row for each (trace_id, id): the one ingested first."""
    rest = [c for c in s.columns if c not in ("trace_id", "id", "_when")]
    return s.groupBy("trace_id", "id").agg(F.min_by(F.struct(*rest), "_when").alias("_s")).select("trace_id", "id", "_s.*")


def base(spans: DataFrame, safe: bool = False, with_text: bool = False) -> Base:
    """The base tables. Everything is read off the single row first, so that texts and attributes don't move: the shuffles that find repeated rows carry names,
    numbers and hashes, of all spans once and of tool calls once. Deliveries of one span are taken to be of one kind.

    ``safe`` leaves texts unread: fingerprints are then missing. Text columns that are absent count as null.
    """
    s = _completed(spans)
    more = {}
    if with_text:
        from spanwright.operators.completion import bounded

        some = [F.when(F.char_length(F.try_element_at("attributes", F.lit(k))) <= FACT_CHARS, F.concat(F.lit(f"{k}="), F.try_element_at("attributes", F.lit(k)))) for k in FACT_KEYS]
        failed = F.col("error").isNotNull() | F.coalesce(F.col("source_status") == "error", F.lit(False))
        io = F.struct(bounded(F.col("input")).alias("_in"), bounded(F.col("output")).alias("_out"), failed.alias("_failed"), F.coalesce("source_status", F.lit("unset")).alias("_source"), F.when(F.col("_kind") == "tool", F.concat_ws(" ", *some)).alias("_facts"))
        more = {"_io": F.when(F.col("_kind").isin("tool", "agent", "chain"), io)}
    all_ = s.select("trace_id", "id", "_when", "pos", "ended_at", _root_of().alias("_root"), _decision_of().alias("_decision"), _cover_of().alias("_cover"), *[v.alias(k) for k, v in more.items()])
    return Base(_first(all_), _first(_calls_of(s.filter(F.col("_kind") == "tool").withColumns(more), safe, list(more))))


def _based(spans: DataFrame | Base, safe: bool = False) -> Base:
    return spans if isinstance(spans, Base) else base(spans, safe)


def _calls_of(s: DataFrame, safe: bool, more: list[str]) -> DataFrame:
    own_name, told = _attr("tool_name"), _attr("operation")
    structured = attr_bool(F.col("attributes"), *KEYS["result_success"])
    out = F.try_parse_json(F.col("output"))
    of_output = F.coalesce(
        as_bool(F.try_variant_get(out, "$.success", "string")),
        as_bool(F.try_variant_get(out, "$.ok", "string")),
        F.when(F.schema_of_variant(out).contains("error: VOID"), True).when(F.schema_of_variant(out).rlike(r"(^OBJECT<|, )error: "), False),
    )
    s = s.withColumns(
        {
            "_result": structured if safe else F.coalesce(structured, of_output),
            "_told": ascii_lower(F.coalesce(_attr("status"), F.lit(""))),
            "_error": ascii_lower(F.coalesce("error", F.lit(""))),
            "_source": F.coalesce("source_status", F.lit("unset")),
        }
    )
    exception = F.col("attributes").getItem("exception.type").isNotNull() | F.col("attributes").getItem("exception.message").isNotNull() | F.coalesce(attr_bool(F.col("attributes"), "exception.recorded"), F.lit(False))
    protocol = attr_count(F.col("attributes"), *KEYS["protocol"])
    flag = lambda name: F.coalesce(attr_bool(F.col("attributes"), *KEYS[name]), F.lit(False))
    is_status = lambda *xs: F.col("_told").isin(*xs)
    status = (
        F.when(F.col("_result") == F.lit(False), "failed")
        .when(flag("timeout") | F.col("_told").contains("timeout") | _contains_any(F.col("_error"), ["timeout", "timed out"]), "timed_out")
        .when(flag("cancelled") | F.col("_told").contains("cancel") | F.col("_error").contains("cancel"), "cancelled")
        .when((F.col("_source") == "error") | exception | F.col("error").isNotNull() | is_status("failed", "failure", "error"), "failed")
        .when(protocol >= 400, "failed")
        .when(is_status("unknown", "uncertain", "ambiguous", "incomplete"), "unknown")
        .when((F.col("_source") == "ok") | (F.col("_result") == F.lit(True)) | is_status("succeeded", "success", "ok", "completed"), "succeeded")
    )
    s = s.withColumn("_status", status).withColumn("status", F.coalesce("_status", F.lit("unknown")))
    message = F.coalesce("error", _attr("error_message"))
    kind = F.coalesce(
        _attr("error_kind"), F.when(F.col("status") == "timed_out", "timeout").when(F.col("status") == "cancelled", "cancelled").when(F.col("status") == "unknown", "unknown").otherwise(error_kind_of_message(message))
    )
    bad = F.col("status") != "succeeded"
    delta = _attr("state_delta")
    no_delta = delta.isNull() | F.regexp_replace(delta, r"\s+", "").isin("", "{}", "[]", "null", '""')
    seen = alias_value(_attr("observation"), OBSERVATIONS, "unknown")
    changed = seen.isNotNull() | ~no_delta
    predicate = _attr("predicate")
    artifact = F.coalesce(F.concat(F.lit("state_artifact:"), _attr("artifact")), F.concat(F.lit("state_change:"), F.col("id"), F.lit(":"), hash_text(canonical_json(delta))), F.concat(F.lit("state_change:"), F.col("id")))
    none = (F.lit(None).cast("string"), F.lit("missing"))
    inv, inv_q = none if safe else _fingerprint(KEYS["invocation"], "input")
    res, res_q = none if safe else _fingerprint(KEYS["result"], "output")
    start, end = instant_us(F.col("started_at")), instant_us(F.col("ended_at"))
    positive = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0)))
    span_us = positive(end - start)
    nano = F.coalesce(F.col("duration_nano"), positive(F.col("end_time_unix_nano") - F.col("start_time_unix_nano")))
    # Numeric instants first, then attributes, then the instants that the texts name.
    ms = F.coalesce(F.floor((nano + 500_000) / 1_000_000), F.round(positive(attr_number(F.col("attributes"), *KEYS["duration_ms"]))).cast("long"), F.round(positive(attr_number(F.col("attributes"), *KEYS["duration_s"])) * 1000).cast("long"), F.floor((span_us + 500) / 1000))
    own_id = _attr("call_id")
    fields = {
        "call_id": F.when(is_identity(own_id), own_id).otherwise(F.col("id")),
        "tool_name": F.coalesce(own_name, F.col("name"), F.lit("")),
        "tool_name_quality": F.when(own_name.isNotNull(), "explicit").otherwise("derived"),
        "_operation": F.when(is_label(told), told),
        "_effect": alias_value(_attr("effect"), EFFECTS, "unknown"),
        "_retry_safety": alias_value(_attr("retry_safety"), RETRY_SAFETY, "unknown"),
        "_requirement": alias_value(_attr("requirement"), REQUIREMENTS, "unknown"),
        "status": F.col("status"),
        "status_quality": F.when((F.col("_result") == F.lit(False)) & (F.col("_source") == "ok"), "ambiguous").when(F.col("_status").isNull(), "missing").otherwise("explicit"),
        "error_kind": F.when(bad, kind),
        "error_code": F.when(bad, F.coalesce(_attr("error_code"), protocol.cast("string"))),
        "retryable": F.when(bad, F.coalesce(attr_bool(F.col("attributes"), *KEYS["retryable"]), F.when(F.col("status") == "timed_out", True).when(F.col("status") == "cancelled", False))),
        "error_hash": F.when(bad & (message != ""), hash_text(message)),
        "invocation_fingerprint": inv,
        "invocation_quality": inv_q,
        "result_fingerprint": res,
        "result_quality": res_q,
        "_attempt": attr_count(F.col("attributes"), *KEYS["attempt"]),
        "started_at": F.coalesce("started_at", "ended_at", F.lit("")),
        "duration_ms": F.coalesce(ms, F.lit(0)).cast("long"),
        "has_duration": F.coalesce(ms > 0, F.lit(False)),
        "approval_required": flag("approval_required"),
        "approval_outcome": alias_value(_attr("approval_outcome"), APPROVALS, "unknown"),
        "observation": F.when(changed, F.coalesce(seen, F.lit("unverified"))),
        "predicate": F.when(changed & is_label(predicate), predicate),
        "artifact": F.when(changed, artifact),
    }
    return s.select("trace_id", "id", "_when", "pos", *more, *[v.alias(k) for k, v in fields.items()])


def _root_of() -> Column:
    """What a span says as its trace's root agent; null for spans that can't be one. ``_c``: the rank of its claim to be the root."""
    choice = (
        F.when(F.col("parent_id").isNull() & (F.col("_kind") == "agent"), 0)
        .when((F.col("_kind") == "agent") & (F.col("input").isNotNull() | F.col("output").isNotNull()), 1)
        .when(F.col("parent_id").isNull() & F.col("_kind").isin("agent", "chain"), 2)
    )
    told = {c: _attr(c) for c in ("final_status", "escalation", "claims", "claim_status", "claim_operation", "claim_call_id")}
    return F.when(choice.isNotNull(), F.struct(choice.alias("_c"), F.col("error").isNotNull().alias("failed"), *[v.alias(k) for k, v in told.items()]))


def _decision_of() -> Column:
    fields = {
        "decision_id": F.coalesce(_attr("decision_id"), F.concat(F.lit("decision:"), F.col("id"))),
        "policy_id": _attr("policy_id"),
        "action": _attr("policy_action"),
        "outcome": alias_value(_attr("policy_outcome"), POLICY_OUTCOMES, "unknown"),
        "reason_code": _attr("policy_reason"),
        "evidence": F.concat(F.lit("span:"), F.col("id")),
    }
    return F.when(_attr("policy_outcome").isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def _cover_of() -> Column:
    has = lambda *keys: F.coalesce(attr(F.col("attributes"), *keys).isNotNull(), F.lit(False))
    verifies = F.coalesce(F.col("kind") == "evaluator", F.lit(False)) | F.coalesce(ascii_lower(attr(F.col("attributes"), "agent.role")) == "verifier", F.lit(False))
    return F.struct(
        (F.coalesce("source_status", F.lit("unset")) != "unset").alias("status"),
        (instant_us(F.col("started_at")).isNotNull() & instant_us(F.col("ended_at")).isNotNull()).alias("timed"),
        has(*KEYS["operation"]).alias("operation"),
        has(*KEYS["final_status"], "gen_ai.output.type").alias("final"),
        verifies.alias("verifier"),
    )


def call_rows(spans: DataFrame | Base, mappings: DataFrame | None = None, safe: bool = False) -> DataFrame:
    """Tool calls without their numbers in the trace. ``mappings`` (tool_name, operation, effect, retry_safety, requirement) fills what the span doesn't say."""
    s = _based(spans, safe).calls.withColumnRenamed("id", "span_id")
    parts = ("operation", "effect", "retry_safety", "requirement")
    if mappings is None:
        s = s.withColumns({f"_m_{c}": F.lit(None).cast("string") for c in parts})
    else:
        m = mappings.filter("tool_name is not null").groupBy("tool_name").agg(*[F.min(c).alias(f"_m_{c}") for c in parts])
        s = s.join(m, "tool_name", "left")
    s = s.withColumns(
        {
            "operation": F.coalesce("_operation", "_m_operation"),
            "operation_quality": F.when(F.col("_operation").isNotNull(), "explicit").when(F.col("_m_operation").isNotNull(), "derived").otherwise("missing"),
            **{c: F.coalesce(f"_{c}", f"_m_{c}", F.lit("unknown")) for c in parts[1:]},
        }
    )
    return s.drop(*[f"_{c}" for c in parts], *[f"_m_{c}" for c in parts])


def calls(spans: DataFrame | Base, mappings: DataFrame | None = None, safe: bool = False, big: DataFrame | None | bool = True, limit: int = LIMIT) -> DataFrame:
    """One row for each tool call. ``idx`` (bigint from 0) is its place among the calls of its trace.

    ``big``: the traces with more calls than a task should hold, or None if there are none, where known.
    """
    b = spans
    if not isinstance(b, Base):
        made = base(spans, safe)
        b = Base(made.spans, Scratch(spans.sparkSession, "base").keep(made.calls))
    s = call_rows(b, mappings, safe)
    big = large_calls(b, limit) if big is True else big
    s = running(s, "trace_id", "pos", {"_n": "cast(1 as bigint)"}, limit, big=big).withColumn("idx", F.col("_n") - 1).drop("_n")
    pair = s.withColumn("_pair", F.to_json(F.struct("trace_id", "tool_name", "operation")))
    # A tool of a trace has no more calls than the trace.
    s = running(pair, "_pair", "pos", {"_n": "cast(1 as bigint)"}, limit, big=None if big is None else True).withColumn("attempt", F.coalesce("_attempt", "_n")).drop("_n", "_attempt", "_pair")
    progress = (F.col("status") == "succeeded") & (F.col("effect").isin("verifying", "compensating", "escalating") | F.coalesce(F.col("observation").isin("verified_changed", "verified_unchanged"), F.lit(False)))
    evidence = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("span:"), F.col("span_id")), F.col("artifact"))))
    return s.withColumns({"progress": progress, "evidence": evidence})


def large_calls(b: Base, limit: int = LIMIT) -> DataFrame | None:
    """The traces with more than ``limit`` calls, or None."""
    return large_keys(b.calls.select("trace_id"), "trace_id", limit, Scratch(b.calls.sparkSession, "large"))


def roots(spans: DataFrame | Base) -> DataFrame:
    """The root agent of each trace, if there is one: the first agent without parent, else the first agent with a text, else the first agent or chain without parent."""
    b = _based(spans).spans.filter("_root is not null")
    more = ["_io"] if "_io" in b.columns else []
    best = b.groupBy("trace_id").agg(F.min_by(F.struct("id", "ended_at", "_root", *more), F.struct("_root._c", "pos")).alias("r"))
    return best.select("trace_id", F.col("r.id").alias("root_id"), F.col("r.ended_at").alias("ended_at"), "r._root.*", *[F.col(f"r.{c}").alias(c) for c in more]).drop("_c")


def outcomes(spans: DataFrame | Base) -> DataFrame:
    """One row for each trace: ``final_status``, ``escalation``, ``root_id`` (null without a root agent), ``observed_at``."""
    b = _based(spans).spans
    # One pass: the last end of all spans and the best claim to be the root, map-side.
    first = F.min_by(F.when(F.col("_root").isNotNull(), F.struct("id", "ended_at", "_root.failed", "_root.final_status", "_root.escalation")), F.when(F.col("_root").isNotNull(), F.struct("_root._c", "pos")))
    t = b.groupBy("trace_id").agg(F.max_by("ended_at", F.when(F.col("ended_at").isNotNull(), F.col("pos"))).alias("_last"), first.alias("r"))
    r = F.col("r")
    status = F.coalesce(alias_value(r["final_status"], FINAL_STATUSES, None), F.when(r["failed"], "failed"), F.lit("unknown"))
    return t.select("trace_id", r["id"].alias("root_id"), status.alias("final_status"), F.coalesce(alias_value(r["escalation"], ESCALATIONS, "unknown"), F.lit("unknown")).alias("escalation"), F.coalesce(r["ended_at"], "_last").alias("observed_at"))


def claims(spans: DataFrame | Base) -> DataFrame:
    """One row for each outcome claim of a root agent: ``k`` (its place), ``operation``, ``call_id``, ``claimed``, ``evidence``."""
    r = roots(spans)
    kind = "array<struct<status:string,operation:string,call_id:string>>"
    listed = F.coalesce(F.from_json("claims", kind), F.array().cast(kind))
    r = r.withColumn("_l", F.filter(listed, lambda c: alias_value(c["status"], CLAIM_STATUSES, None).isNotNull()))
    single = F.struct(F.col("claim_status").alias("status"), F.col("claim_operation").alias("operation"), F.col("claim_call_id").alias("call_id"))
    r = r.withColumn("_l", F.when(F.size("_l") > 0, F.col("_l")).when(alias_value(F.col("claim_status"), CLAIM_STATUSES, None).isNotNull(), F.array(single)))
    c = r.filter("_l is not null").select("trace_id", "root_id", F.posexplode("_l").alias("k", "c"))
    return c.select(
        "trace_id",
        "k",
        F.when(is_label(F.col("c.operation")), F.col("c.operation")).alias("operation"),
        F.when(is_identity(F.col("c.call_id")), F.col("c.call_id")).alias("call_id"),
        alias_value(F.col("c.status"), CLAIM_STATUSES, None).alias("claimed"),
        F.concat(F.lit("outcome_claim:"), F.col("root_id"), F.lit(":"), F.col("k").cast("string")).alias("evidence"),
    )


def decisions(spans: DataFrame | Base) -> DataFrame:
    """One row for each policy decision: any span with a policy outcome."""
    return _based(spans).spans.filter("_decision is not null").select("trace_id", "pos", "_decision.*")


def coverage(spans: DataFrame | Base) -> DataFrame:
    """One row for each trace: counts of its spans by what they say, and the qualities of operation identity, final outcome and verifier."""
    told = lambda flag: F.when(F.max(f"_cover.{flag}"), "explicit").otherwise("missing")
    return _based(spans).spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if("_cover.status").alias("explicit_status_spans"),
        F.count_if("_cover.timed").alias("timed_spans"),
        told("operation").alias("operation_identity"),
        told("final").alias("final_outcome"),
        told("verifier").alias("verifier"),
    )
