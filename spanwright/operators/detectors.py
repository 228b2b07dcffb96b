"""Detectors over behaviour facts: each gives findings, one row each.

A finding has ``trace_id``, ``detector_id``, ``detector_version``, ``severity``, ``recovery``, ``subject``, ``operation``, ``error_kind``, ``evidence`` (sorted
distinct identities), ``metadata`` (map), ``finding_id`` and ``failure_signature`` (content hashes) and ``created_at``. Rules that ask for a later
call ("an equal call succeeded later") are joins with the last place of such calls by key, not pairs of calls, so that
they aggregate map-side; the right sides' few rows of a huge trace are copied to the parts that its calls are dealt to. Loops are
found by joins on numbered calls. Episodes stream through sorted partitions: their state is one window of calls, but all failures of one call
between two successes stand in one task.

Defined results: traces without calls give only findings on their outcome; ties can't occur, as places are unique; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import hash_parts
from spanwright.operators import behavior as B
from spanwright.operators.slices import LIMIT, running, spread_join
from spanwright.session import Scratch

VERSION = "6"
FAILED = ["failed", "timed_out", "cancelled"]
OBSERVED = ["explicit", "derived"]
MOST_EVIDENCE = 10_000  # evidences in a row of excessive_tool_usage

# The facts that detectors need.
REQUIRED_FACTS = {
    "terminal_tool_failure": ["final_outcome", "source_status", "tool_requirement"],
    "repeated_tool_failure": ["invocation_fingerprint", "source_status", "tool_identity"],
    "tool_call_loop": ["invocation_fingerprint", "source_status", "tool_identity"],
    "uncertain_mutation_state": ["operation_identity", "source_status", "state_observation"],
    "false_success_claim": ["final_outcome", "source_status"],
    "approval_bypass": ["policy_semantics"],
    "policy_violation": ["policy_semantics"],
    "excessive_tool_usage": ["numeric_duration"],
    "unresolved_escalation": ["final_outcome", "policy_semantics"],
    "missing_resolution": ["final_outcome"],
}
NEEDS_CALLS = ["terminal_tool_failure", "repeated_tool_failure", "tool_call_loop", "uncertain_mutation_state", "approval_bypass", "excessive_tool_usage"]


@dataclass
class Limits:
    repeated_failures: int = 3
    failure_window: int = 8
    loop_calls: int = 4
    tool_calls: int = 25
    duration_ms: int = 60_000


@dataclass
class Facts:
    """The facts that detectors read; ``kept`` tables are written once and read by all detectors."""

    calls: DataFrame
    outcomes: DataFrame
    claims: DataFrame
    decisions: DataFrame
    coverage: DataFrame
    adapter: tuple[str, str] = ("default", "1")
    big: DataFrame | None = None  # traces with more calls than a task should hold
    _recovery: DataFrame | None = field(default=None, repr=False)

    @staticmethod
    def of(spans: DataFrame, mappings: DataFrame | None = None, safe: bool = False, limit: int = LIMIT) -> Facts:
        """All facts from base tables that hold one row a span."""
        b = B.base(spans, safe).kept()
        big = B.large_calls(b, limit)
        tables = [lambda: B.calls(b, mappings, safe, big, limit), lambda: B.outcomes(b)]
        with ThreadPoolExecutor(len(tables)) as pool:  # independent jobs, side by side
            kept = [pool.submit(lambda t=t: Scratch(spans.sparkSession, "facts").keep(t())) for t in tables]
            calls, outcomes = (k.result() for k in kept)
        return Facts(calls, outcomes, B.claims(b), B.decisions(b), B.coverage(b), big=big)

    def recovery(self) -> DataFrame:
        if self._recovery is None:
            self._recovery = Scratch(self.calls.sparkSession, "recovery").keep(recovery(self))
        return self._recovery


def _same(*names: str) -> Column:
    """One text for several columns, null told from ''."""
    return F.to_json(F.struct(*[F.col(n) for n in names]))


def _claimed_calls(f: Facts) -> DataFrame:
    """(trace_id, idx, claimed, k): the calls that each claim means: by call id if it names one, else by operation."""
    c = f.claims.select("trace_id", "k", "claimed", F.col("call_id").alias("_cid"), F.col("operation").alias("_op"))
    by_id = c.filter("_cid is not null").join(f.calls.select("trace_id", "idx", F.col("call_id").alias("_cid")), ["trace_id", "_cid"])
    by_op = c.filter("_cid is null and _op is not null").join(f.calls.select("trace_id", "idx", F.col("operation").alias("_op")), ["trace_id", "_op"])
    return by_id.select("trace_id", "idx", "claimed", "k").unionByName(by_op.select("trace_id", "idx", "claimed", "k"))


def recovery(f: Facts) -> DataFrame:
    """(trace_id, idx, recovery) of all calls: recovered, unrecovered or unknown.

    In this order: succeeded; a later equal idempotent call succeeded; a later call reached the same state, or verified it (for
    mutations), or compensated it; a later call of the same tool and operation succeeded (unknown); what claims say; an escalation;
    unknown status; else unrecovered.
    """
    c = f.calls.withColumns({"_equal": F.when(F.col("invocation_fingerprint").isNotNull(), _same("tool_name", "operation", "effect", "invocation_fingerprint")), "_alike": _same("tool_name", "operation", "effect")})
    won = c.filter("status = 'succeeded'")
    open_ = c.filter("status <> 'succeeded'")
    last = lambda key, where, name: won.filter(where).filter(F.col(key).isNotNull()).groupBy("trace_id", key).agg(F.max("idx").alias(name))
    verified = "observation in ('verified_changed', 'verified_unchanged')"
    side = lambda left, right, on: spread_join(left, right, on, "trace_id", f.big)
    x = side(side(open_, last("_equal", "true", "_l1"), ["trace_id", "_equal"]), last("_alike", "true", "_l5"), ["trace_id", "_alike"])
    by_state = (
        won.filter("predicate is not null")
        .groupBy("trace_id", "predicate")
        .agg(F.max(F.expr("case when observation = 'verified_changed' then idx end")).alias("_l2"), F.max(F.expr(f"case when effect = 'verifying' and {verified} then idx end")).alias("_l3"), F.max(F.expr("case when effect = 'compensating' then idx end")).alias("_l4"))
    )
    x = side(x, by_state, ["trace_id", "predicate"])
    said = _claimed_calls(f).groupBy("trace_id", "idx").agg(
        F.max(F.col("claimed") == "succeeded").alias("_c1"), F.max(F.col("claimed").isin("failed", "not_completed")).alias("_c2"), F.max(F.col("claimed") == "state_unknown").alias("_c3")
    )
    x = side(x.join(said, ["trace_id", "idx"], "left"), f.outcomes.select("trace_id", "final_status", "escalation"), ["trace_id"])
    i = F.col("idx")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    r = (
        F.when((F.col("_l1") > i) & (F.col("retry_safety") == "idempotent"), "recovered")
        .when(F.col("_l2") > i, "recovered")
        .when((F.col("effect") == "mutating") & (F.col("_l3") > i), "recovered")
        .when(F.col("_l4") > i, "recovered")
        .when(F.col("_l5") > i, "unknown")
        .when(yes("_c1"), "unrecovered")
        .when(yes("_c2"), "recovered")
        .when(yes("_c3"), "unknown")
        .when((F.col("escalation") == "required_and_performed") & (F.col("final_status") == "escalated"), "recovered")
        .when(F.col("status") == "unknown", "unknown")
        .otherwise("unrecovered")
    )
    return x.select("trace_id", "idx", r.alias("recovery")).unionByName(won.select("trace_id", "idx", F.lit("recovered").alias("recovery")))


RAW = ["trace_id", "recovery", "subject", "operation", "error_kind", "evidence", "metadata"]


def _findings(df: DataFrame, detector: str, severity: str) -> DataFrame:
    """Rows of a detector before their identities."""
    return df.select(*RAW, F.lit(detector).alias("detector_id"), F.lit(severity).alias("severity"))


def _complete(df: DataFrame, f: Facts) -> DataFrame:
    last_call = f.calls.groupBy("trace_id").agg(F.max_by("started_at", "idx").alias("_last"))
    seen = f.outcomes.select("trace_id", F.col("observed_at").alias("_seen")).join(last_call, "trace_id", "left")
    df = spread_join(df, seen, ["trace_id"], "trace_id", f.big)
    evidence = F.sort_array(F.array_distinct(F.filter("evidence", lambda e: e.isNotNull())))
    own = F.map_filter("metadata", lambda k, v: v.isNotNull())
    more = F.map_filter(
        F.create_map(F.lit("subject"), F.col("subject"), F.lit("operation"), F.col("operation"), F.lit("error_kind"), F.col("error_kind"), F.lit("adapter.id"), F.lit(f.adapter[0]), F.lit("adapter.version"), F.lit(f.adapter[1])),
        lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k),
    )
    df = df.withColumns({"evidence": evidence, "metadata": F.map_concat(own, more)})
    return df.select(
        hash_parts(F.col("trace_id"), F.col("detector_id"), F.lit(VERSION), more=F.col("evidence")).alias("finding_id"),
        "detector_id",
        F.lit(VERSION).alias("detector_version"),
        "trace_id",
        "severity",
        "recovery",
        "subject",
        "operation",
        "error_kind",
        hash_parts(F.col("detector_id"), F.col("subject"), F.coalesce("operation", F.lit("")), F.coalesce("error_kind", F.lit(""))).alias("failure_signature"),
        "evidence",
        F.coalesce("_seen", F.when(F.col("_last") != "", F.col("_last")), F.lit("unknown")).alias("created_at"),
        "metadata",
    )


def _map(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))]) if columns else F.create_map().cast("map<string,string>")


def _of_calls(df: DataFrame, f: Facts, detector: str, severity: str) -> DataFrame:
    rows = df.select("trace_id", "recovery", F.col("tool_name").alias("subject"), "operation", "error_kind", "evidence", _map(tool_name=F.col("tool_name"), operation=F.col("operation"), call_id=F.col("call_id")).alias("metadata"))
    return _findings(rows, detector, severity)


def terminal_tool_failure(f: Facts, limits: Limits) -> DataFrame:
    c = f.calls.filter(F.col("requirement") == "required").filter(F.col("status").isin(*FAILED)).join(f.recovery(), ["trace_id", "idx"]).filter("recovery = 'unrecovered'")
    return _of_calls(c, f, "terminal_tool_failure", "high")


def _identity(c: DataFrame, strict: bool) -> Column:
    """Key of calls that are the same call: tool, operation or tool identity, fingerprint; null where these aren't well known.

    ``strict``: an operation said to be known must be there, else there is no key.
    """
    known_op = F.col("operation_quality").isin(*OBSERVED)
    by_op = known_op if strict else known_op & F.col("operation").isNotNull()
    who = F.when(by_op, F.when(F.col("operation").isNotNull(), F.concat(F.lit("operation:"), F.col("operation")))).when(F.col("tool_name_quality").isin(*OBSERVED), F.concat(F.lit("tool:"), F.col("tool_name")))
    return F.when(F.col("invocation_quality").isin(*OBSERVED) & who.isNotNull() & F.col("invocation_fingerprint").isNotNull(), F.to_json(F.struct("tool_name", who.alias("w"), "invocation_fingerprint")))


def failure_episodes(f: Facts, limits: Limits) -> DataFrame:
    """(trace_id, first_idx, last_idx, n, places): repeated failures of the same call within a window of calls, none of whose tool calls succeeded meanwhile."""
    most, window = max(1, limits.repeated_failures), max(limits.failure_window, limits.repeated_failures, 1)
    c = running(f.calls.select("trace_id", "idx", "status", "tool_name", "tool_name_quality", "operation", "operation_quality", "invocation_fingerprint", "invocation_quality", "error_kind"), "trace_id", "idx", {"_seg": "case when status = 'succeeded' then 1L else 0L end"})
    c = c.withColumn("_id", F.when(F.col("status").isin(*FAILED), _identity(c, True))).filter("_id is not null")
    c = c.select("trace_id", "idx", F.xxhash64("trace_id", "_seg", "_id", F.coalesce("error_kind", F.lit("unknown"))).alias("_h"), F.concat_ws("\x1f", F.col("_seg").cast("string"), "_id", F.coalesce("error_kind", F.lit("unknown"))).alias("_k"))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, places = None, []
        for p in parts:
            out = []
            for t, i, k in zip(p["trace_id"], p["idx"], p["_k"]):
                if (t, k) != key or i - places[0] >= window:
                    if key is not None and len(places) >= most:
                        out.append((key[0], places[0], places[-1], len(places), places))
                    key, places = (t, k), []
                places.append(int(i))
            if out:
                yield pd.DataFrame(out, columns=["trace_id", "first_idx", "last_idx", "n", "places"])
        if key is not None and len(places) >= most:
            yield pd.DataFrame([(key[0], places[0], places[-1], len(places), places)], columns=["trace_id", "first_idx", "last_idx", "n", "places"])

    ordered = c.repartition("_h").sortWithinPartitions("trace_id", "_k", "idx").select("trace_id", "idx", "_k")
    return ordered.mapInPandas(fold, "trace_id string, first_idx bigint, last_idx bigint, n bigint, places array<bigint>")


def repeated_tool_failure(f: Facts, limits: Limits) -> DataFrame:
    e = failure_episodes(f, limits)
    of_all = e.select("trace_id", "first_idx", "last_idx", "n", F.explode("places").alias("idx")).join(f.calls.select("trace_id", "idx", F.col("evidence").alias("_ev")), ["trace_id", "idx"])
    ev = of_all.groupBy("trace_id", "first_idx", "last_idx", "n").agg(F.flatten(F.collect_list("_ev")).alias("evidence"))
    last = f.calls.select("trace_id", F.col("idx").alias("last_idx"), "tool_name", "operation", "error_kind", "invocation_fingerprint")
    rows = ev.join(last, ["trace_id", "last_idx"]).join(f.recovery().withColumnRenamed("idx", "last_idx"), ["trace_id", "last_idx"])
    meta = _map(failure_count=F.col("n"), retry_limit=F.lit(limits.repeated_failures), episode_start_call=F.col("first_idx"), episode_end_call=F.col("last_idx"), call_window=F.lit(limits.failure_window), invocation_fingerprint=F.col("invocation_fingerprint"))
    return _findings(rows.select("trace_id", "recovery", F.col("tool_name").alias("subject"), "operation", "error_kind", "evidence", meta.alias("metadata")), "repeated_tool_failure", "high")


_P = (1 << 31) - 1
_BASES = (1_103_515_245 % _P, 69_069)


def _power(base: int, n: Column) -> Column:
    """base^n modulo the prime, for n below 2^42, by the bits of n."""
    out = F.lit(1).cast("long")
    for bit in range(42):
        out = out * F.when(n.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(pow(base, 1 << bit, _P))).otherwise(F.lit(1)) % _P
    return out


def loops(f: Facts, limits: Limits, limit: int = LIMIT) -> DataFrame:
    """(trace_id, first_idx, last_idx, cycle_length): of each stretch of calls without progress the loop that ends first: ``loop_calls`` equal calls with equal calls between each two.

    What stands between two calls is known by the difference of running polynomial hashes (two moduli's worth of 31 bits). Each call meets the
    call of its key before it by a join on the call's number among its key's, so that neither a trace nor a key has to fit in a task.
    """
    n = max(2, limits.loop_calls)
    c = f.calls.withColumn("_id", _identity(f.calls, False))
    c = c.withColumn("_cut", F.col("progress") | F.col("_id").isNull()).select("trace_id", "idx", F.xxhash64("_id").alias("_k"), "_cut")
    scratch = Scratch(f.calls.sparkSession, "loops")
    often = c.filter("not _cut").groupBy("trace_id", "_k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select("trace_id").distinct()
    c = spread_join(c, often.withColumn("_may", F.lit(True)), ["trace_id"], "trace_id", f.big, "inner").drop("_may")
    terms = {f"_s{j}": f"(pmod(_k, {_P}L) + 1) * _b{j} % {_P}L" for j in range(2)}
    c = c.withColumns({f"_b{j}": _power(b, F.col("idx")) for j, b in enumerate(_BASES)})
    c = running(c, "trace_id", "idx", {"_seg": "case when _cut then 1L else 0L end"} | terms, limit, big=f.big).filter("not _cut")
    c = c.withColumn("_key", F.to_json(F.struct("trace_id", "_seg", "_k")))
    c = scratch.keep(running(c, "_key", "idx", {"_r": "1L"}, limit, big=None if f.big is None else True).select("trace_id", "_seg", "idx", "_key", "_r", "_s0", "_s1", "_b0", "_b1", (F.col("_k") % _P).alias("_m")))
    before = lambda d, df, cols: df.select("_key", (F.col("_r") + d).alias("_r"), *cols)
    one = c.join(before(1, c, [F.col("idx").alias("_i"), F.col("_s0").alias("_t0"), F.col("_s1").alias("_t1")]), ["_key", "_r"])
    gap = F.col("idx") - F.col("_i")
    # Between the two calls, ends left out: the difference less the later call's own term.
    own = lambda j: (F.pmod(F.col("_m"), F.lit(_P)) + 1) * F.col(f"_b{j}") % _P
    one = scratch.keep(one.select("trace_id", "_seg", "_key", "_r", "idx", gap.alias("_g"), *[F.pmod(F.col(f"_s{j}") - F.col(f"_t{j}") - own(j), F.lit(_P)).alias(f"_d{j}") for j in range(2)]))
    if n == 2:
        hit = one
    else:
        two = one.join(before(1, one, [F.col("_g").alias("_h"), F.col("_d0").alias("_e0"), F.col("_d1").alias("_e1")]), ["_key", "_r"])
        same = F.col("_g") == F.col("_h")
        for j, b in enumerate(_BASES):
            same = same & (F.pmod(F.col(f"_e{j}") * _power(b, F.col("_g")), F.lit(_P)) == F.col(f"_d{j}"))
        # n equal calls are n - 2 equal neighbours of gaps in a row: none of the last n - 2 differs.
        flags = running(two.withColumn("_odd", F.when(same, F.lit(0)).otherwise(F.lit(1))), "_key", "_r", {"_odds": "cast(_odd as bigint)"}, limit, big=None if f.big is None else True)
        if n == 3:
            hit = flags.filter("_odd = 0")
        else:
            flags = scratch.keep(flags)
            start = before(n - 3, flags, [(F.col("_odds") - F.col("_odd")).alias("_then")])
            hit = flags.join(start, ["_key", "_r"]).filter("_odds = _then")
    best = hit.groupBy("trace_id", "_seg").agg(F.min(F.struct("idx", "_g")).alias("m"))
    return best.select("trace_id", (F.col("m.idx") - (n - 1) * F.col("m._g")).alias("first_idx"), F.col("m.idx").alias("last_idx"), F.col("m._g").alias("cycle_length"))


def tool_call_loop(f: Facts, limits: Limits) -> DataFrame:
    """Its evidence is all calls from the loop's first to its last: a finding's row holds them all, and its id is one over them all."""
    e = loops(f, limits).join(f.outcomes.select("trace_id", "final_status", "escalation"), "trace_id", "left")
    rec = (
        F.when(F.col("final_status").isin("completed", "safely_refused"), "recovered")
        .when(F.col("final_status").isin("failed", "incomplete"), "unrecovered")
        .when((F.col("final_status") == "escalated") & (F.col("escalation") == "required_and_performed"), "recovered")
        .otherwise("unknown")
    )
    # What a loop is goes with its calls' numbers, so that whole evidence is moved only once it is grouped.
    places = e.select("trace_id", "first_idx", "cycle_length", rec.alias("recovery"), F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    # The planner can't know how many places there are: without the hint it may broadcast them.
    inside = places.hint("merge").join(f.calls.select("trace_id", "idx", "tool_name", "operation", "error_kind", F.col("evidence").alias("_ev")), ["trace_id", "idx"])
    rows = inside.groupBy("trace_id", "first_idx", "cycle_length", "recovery").agg(F.flatten(F.collect_list("_ev")).alias("evidence"), F.max_by(F.struct("tool_name", "operation", "error_kind"), "idx").alias("_last"))
    meta = _map(call_count=F.lit(max(2, limits.loop_calls)), equivalent_call_limit=F.lit(limits.loop_calls), cycle_length=F.col("cycle_length"))
    return _findings(rows.select("trace_id", "recovery", F.col("_last.tool_name").alias("subject"), F.col("_last.operation").alias("operation"), F.col("_last.error_kind").alias("error_kind"), "evidence", meta.alias("metadata")), "tool_call_loop", "medium")


def uncertain_mutation_state(f: Facts, limits: Limits) -> DataFrame:
    unsure = F.col("status").isin("timed_out", "unknown") | F.coalesce(F.col("observation").isin("ambiguous", "conflicting"), F.lit(False))
    c = f.calls.filter((F.col("effect") == "mutating") & unsure).join(f.recovery(), ["trace_id", "idx"]).filter("recovery <> 'recovered'")
    return _of_calls(c, f, "uncertain_mutation_state", "high")


def false_success_claim(f: Facts, limits: Limits) -> DataFrame:
    meant = _claimed_calls(f).filter("claimed = 'succeeded'").join(f.calls, ["trace_id", "idx"])
    proof = f.calls.filter("status = 'succeeded' and effect = 'verifying' and observation = 'verified_changed' and predicate is not null").groupBy("trace_id", "predicate").agg(F.max("idx").alias("_p"))
    meant = meant.join(proof, ["trace_id", "predicate"], "left")
    per = meant.groupBy("trace_id", "k").agg(
        F.max((F.col("status") == "succeeded") | F.coalesce(F.col("_p") > F.col("idx"), F.lit(False))).alias("_ok"),
        F.max_by(F.struct("tool_name", "operation", "error_kind"), "idx").alias("_last"),
        F.flatten(F.collect_list("evidence")).alias("_ev"),
    )
    c = f.claims.filter("claimed = 'succeeded'").join(per, ["trace_id", "k"], "left").filter(~F.coalesce("_ok", F.lit(False)))
    rows = c.select(
        "trace_id",
        F.lit("unrecovered").alias("recovery"),
        F.coalesce("_last.tool_name", "operation", F.lit("final_outcome")).alias("subject"),
        F.when(F.col("_last").isNotNull(), F.col("_last.operation")).otherwise(F.col("operation")).alias("operation"),
        F.col("_last.error_kind").alias("error_kind"),
        F.concat(F.array("evidence"), F.coalesce("_ev", F.array().cast("array<string>"))).alias("evidence"),
        _map().alias("metadata"),
    )
    return _findings(rows, "false_success_claim", "high")


def _of_outcome(o: DataFrame, f: Facts, detector: str, severity: str, subject: str, more: Column | None = None) -> DataFrame:
    ev = F.array(F.concat(F.lit("span:"), F.col("root_id")))
    rows = o.select("trace_id", F.lit("unrecovered").alias("recovery"), F.lit(subject).alias("subject"), F.lit(None).cast("string").alias("operation"), F.lit(None).cast("string").alias("error_kind"), (ev if more is None else F.concat(ev, more)).alias("evidence"), _map().alias("metadata"))
    return _findings(rows, detector, severity)


def unresolved_escalation(f: Facts, limits: Limits) -> DataFrame:
    asked = f.decisions.filter((F.col("outcome") == "required") & F.col("action").contains("escalat")).groupBy("trace_id").agg(F.collect_set("evidence").alias("_ev"))
    o = f.outcomes.filter("escalation = 'required_and_missing'").join(asked, "trace_id", "left")
    return _of_outcome(o, f, "unresolved_escalation", "high", "escalation", F.coalesce("_ev", F.array().cast("array<string>")))


def missing_resolution(f: Facts, limits: Limits) -> DataFrame:
    return _of_outcome(f.outcomes.filter("final_status in ('incomplete', 'unknown')"), f, "missing_resolution", "medium", "final_outcome")


def approval_bypass(f: Facts, limits: Limits) -> DataFrame:
    c = f.calls.filter("status = 'succeeded' and approval_required and not approval_outcome <=> 'approved'").withColumn("recovery", F.lit("unrecovered"))
    return _of_calls(c, f, "approval_bypass", "critical")


def policy_violation(f: Facts, limits: Limits) -> DataFrame:
    d = f.decisions.filter("outcome = 'denied' and action is not null")
    won = f.calls.filter("status = 'succeeded'")
    by_op = won.filter(F.col("operation_quality").isin(*OBSERVED) & F.col("operation").isNotNull()).select("trace_id", F.col("operation").alias("action"), "idx", "call_id", F.col("evidence").alias("_ev"))
    by_tool = won.filter(F.col("tool_name_quality").isin(*OBSERVED)).select("trace_id", F.col("tool_name").alias("action"), "idx", "call_id", F.col("evidence").alias("_ev"))
    done = by_op.unionByName(by_tool).dropDuplicates(["trace_id", "action", "idx"])
    hit = d.join(done, ["trace_id", "action"]).groupBy("trace_id", "pos", "action", "policy_id", "reason_code", F.col("evidence").alias("_own")).agg(F.array_sort(F.collect_list(F.struct("idx", "call_id", "_ev"))).alias("_c"))
    rows = hit.select(
        "trace_id",
        F.lit("unrecovered").alias("recovery"),
        F.col("action").alias("subject"),
        F.lit(None).cast("string").alias("operation"),
        F.col("reason_code").alias("error_kind"),
        F.concat(F.array("_own"), F.flatten(F.col("_c._ev"))).alias("evidence"),
        _map(policy_id=F.col("policy_id"), reason_code=F.col("reason_code"), executed_call_ids=F.to_json(F.col("_c.call_id"))).alias("metadata"),
    )
    return _findings(rows, "policy_violation", "high")


def tool_usage(f: Facts) -> DataFrame:
    return f.calls.groupBy("trace_id").agg(F.count(F.lit(1)).alias("tool_call_count"), F.sum("duration_ms").alias("total_duration_ms"))


def excessive_tool_usage(f: Facts, limits: Limits) -> DataFrame:
    """Its evidence is the calls of the trace, the first ``MOST_EVIDENCE`` of them in the finding's row; :func:`tool_budget_evidence` has all as rows."""
    over = tool_usage(f).filter((F.col("tool_call_count") > max(1, limits.tool_calls)) | (F.col("total_duration_ms") > max(1, limits.duration_ms)))
    ev = f.calls.filter(F.col("idx") < MOST_EVIDENCE).join(over.select("trace_id"), "trace_id", "left_semi").groupBy("trace_id").agg(F.flatten(F.collect_list("evidence")).alias("evidence"))
    meta = _map(tool_call_count=F.col("tool_call_count"), tool_call_limit=F.lit(limits.tool_calls), total_duration_ms=F.col("total_duration_ms"), total_duration_limit_ms=F.lit(limits.duration_ms))
    rows = over.join(ev, "trace_id").select("trace_id", F.lit("unrecovered").alias("recovery"), F.lit("tool_budget").alias("subject"), F.lit(None).cast("string").alias("operation"), F.lit(None).cast("string").alias("error_kind"), "evidence", meta.alias("metadata"))
    return _findings(rows, "excessive_tool_usage", "medium")


def tool_budget_evidence(f: Facts, limits: Limits) -> DataFrame:
    """(trace_id, ``evidence``): every call of the traces over their budget, a row each."""
    over = tool_usage(f).filter((F.col("tool_call_count") > max(1, limits.tool_calls)) | (F.col("total_duration_ms") > max(1, limits.duration_ms)))
    return f.calls.join(over.select("trace_id"), "trace_id", "left_semi").select("trace_id", F.explode("evidence").alias("evidence"))


DETECTORS = {
    d.__name__: d
    for d in (terminal_tool_failure, repeated_tool_failure, tool_call_loop, uncertain_mutation_state, false_success_claim, unresolved_escalation, missing_resolution, approval_bypass, policy_violation, excessive_tool_usage)
}
#: The profile of detectors that need no product knowledge.
CONSERVATIVE = ["approval_bypass", "false_success_claim", "policy_violation", "repeated_tool_failure", "tool_call_loop", "unresolved_escalation"]


def detect(f: Facts, detectors: list[str] | None = None, limits: Limits | None = None) -> DataFrame:
    """Findings of the named detectors (all by default)."""
    raw = None
    for name in detectors or list(DETECTORS):
        found = DETECTORS[name](f, limits or Limits())
        raw = found if raw is None else raw.unionByName(found)
    return _complete(raw, f)


def detector_coverage(f: Facts, detectors: list[str] | None = None) -> DataFrame:
    """(trace_id, detector_id, status, required_facts, observed_facts, missing_facts, semantic_coverage) for each trace and detector."""
    failed = F.col("status").isin(*FAILED)
    seen = lambda c: F.col(c).isin("explicit", "derived", "inferred")
    all_ = lambda ok: F.coalesce(F.min(ok), F.lit(True))
    c = f.calls.withColumns({"_rep": F.when(failed, _identity(f.calls, True)).isNotNull(), "_eq": _identity(f.calls, False).isNotNull()})
    g = c.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(failed).alias("n_failed"),
        F.count_if(F.col("_rep")).alias("n_rep"),
        F.count_if(F.col("_eq")).alias("n_eq"),
        all_(seen("status_quality")).alias("source_status"),
        all_(F.when(failed, (F.col("operation").isNotNull() & seen("operation_quality")) | seen("tool_name_quality"))).alias("tool_identity"),
        all_(F.col("operation").isNotNull() & seen("operation_quality")).alias("operation_identity"),
        all_(F.when(failed, F.col("invocation_fingerprint").isNotNull() & seen("invocation_quality"))).alias("invocation_fingerprint"),
        all_(F.coalesce("has_duration", F.lit(False))).alias("numeric_duration"),
        all_(F.when(failed, F.col("requirement") != "unknown")).alias("tool_requirement"),
        all_((F.col("effect") != "mutating") | F.coalesce(F.col("observation") != "unknown", F.lit(False))).alias("state_observation"),
    )
    has_policy = f.decisions.select("trace_id").distinct().withColumn("policy_semantics", F.lit(True))
    t = f.coverage.select("trace_id", (F.col("final_outcome") != "missing").alias("final_outcome")).join(g, "trace_id", "left").join(has_policy, "trace_id", "left")
    facts = ["source_status", "tool_identity", "operation_identity", "invocation_fingerprint", "numeric_duration", "tool_requirement", "state_observation"]
    t = t.withColumns({x: F.coalesce(F.col(x), F.lit(True)) for x in facts} | {x: F.coalesce(F.col(x), F.lit(0)) for x in ("n_calls", "n_failed", "n_rep", "n_eq")} | {"policy_semantics": F.coalesce("policy_semantics", F.lit(False))})
    rows = []
    none = F.array().cast("array<string>")
    for d in detectors or list(DETECTORS):
        need = F.array(*[F.lit(x) for x in REQUIRED_FACTS[d]])
        need = F.when(F.col("n_calls") == 0, none).otherwise(need) if d in NEEDS_CALLS else need
        have = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in REQUIRED_FACTS[d]]))
        rows.append(F.struct(F.lit(d).alias("detector_id"), need.alias("required_facts"), F.array_intersect(need, have).alias("observed_facts")))
    r = t.withColumn("r", F.explode(F.array(*rows))).select("trace_id", "r.*", "n_calls", "n_failed", "n_rep", "n_eq", "source_status")
    missing = F.array_except("required_facts", "observed_facts")
    ok = (
        F.when(F.col("detector_id") == "repeated_tool_failure", (F.col("n_rep") >= 3) | ((F.col("n_failed") < 3) & F.col("source_status")))
        .when(F.col("detector_id") == "tool_call_loop", (F.col("n_eq") >= 4) | (F.col("n_calls") < 4))
        .otherwise(F.size(missing) == 0)
    )
    share = F.when(F.size("required_facts") == 0, 1.0).otherwise(F.size("observed_facts") / F.size("required_facts"))
    return r.select("trace_id", "detector_id", F.when(ok, "evaluated").otherwise("inconclusive").alias("status"), "required_facts", "observed_facts", missing.alias("missing_facts"), share.alias("semantic_coverage"))


def detect_report(f: Facts, detectors: list[str] | None = None, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, diagnostics): findings only of detectors whose facts a trace holds, and what telemetry lacks."""
    cover = detector_coverage(f, detectors)
    found = detect(f, detectors, limits).join(cover.filter("status = 'evaluated'").select("trace_id", "detector_id"), ["trace_id", "detector_id"], "left_semi")
    null = F.lit(None).cast("string")
    unsure = cover.filter("status = 'inconclusive'").select("trace_id", F.lit("detector_inconclusive_missing_facts").alias("code"), "detector_id", null.alias("call_id"))
    o = f.coverage.select("trace_id", "final_outcome").join(f.outcomes.select("trace_id", "final_status"), "trace_id", "left")
    code = F.when(F.col("final_outcome") == "missing", "missing_final_outcome").when(F.col("final_status").isin("incomplete", "unknown"), "non_terminal_final_outcome")
    of_trace = o.select("trace_id", code.alias("code"), null.alias("detector_id"), null.alias("call_id")).filter("code is not null")
    op_seen = F.col("operation_quality").isin("explicit", "derived", "inferred")
    facts = F.array(F.struct(F.lit("source_status").alias("f"), F.col("status_quality").alias("q")), F.struct(F.lit("tool_identity").alias("f"), F.when(op_seen, F.col("operation_quality")).otherwise(F.col("tool_name_quality")).alias("q")), F.struct(F.lit("invocation_fingerprint").alias("f"), F.col("invocation_quality").alias("q")))
    of_calls = f.calls.withColumn("x", F.explode(facts)).filter(~F.col("x.q").isin("explicit", "derived", "inferred"))
    of_calls = of_calls.select("trace_id", F.concat(F.when(F.col("x.q") == "ambiguous", "ambiguous_").otherwise("missing_"), F.col("x.f")).alias("code"), null.alias("detector_id"), "call_id")
    return found, unsure.unionByName(of_trace).unionByName(of_calls)
