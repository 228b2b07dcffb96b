"""Facts, recovery chains, compact projections, prompts and features of task completion.

A trace's facts are the user's request and the final answer (of its root agent) and its tool calls, in order. A compact projection keeps a
variant's facts, drops repeated optional ones of a family, and removes the least relevant until its prompt fits a budget of tokens.
The default counter of tokens (words by white space) is additive, so that what has to go is a running sum, not a loop.

Defined results: traces without facts give no rows; unknown counts are 0; shares of nothing are 0; repeated rows of a span are one fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import ascii_lower, escape_tagged, trim_u, word_overlap
from spanwright.operators.behavior import base, call_rows, large_calls, roots
from spanwright.operators.slices import LIMIT, running, spread_join
from spanwright.session import Scratch

# Words of tools and their facts by kind, in the order of precedence; keys of facts; the features' order; texts of sections.
TOOL_WORDS = {"verification": ["test", "verify", "check", "lint", "assert"], "artifact_mutation": ["write", "edit", "patch", "create", "delete", "update"], "external_action": ["browser", "email", "deploy", "publish", "github", "calendar"]}
VARIANTS = ["goal_and_final_response", "mandatory_evidence", "mandatory_with_recovery", "complete"]
FEATURES = ["included_fact_count_log1p", "omitted_fact_count_log1p", "evidence_coverage", "projected_token_ratio", "compression_ratio", "final_response_present", "recovery_chain_count_log1p", "recovered_failure_fraction", "failed_fact_fraction", "succeeded_fact_fraction", "unfinished_fact_fraction", "verification_succeeded_count_log1p", "verification_failed_count_log1p", "verification_missing", "mutation_succeeded_count_log1p", "mutation_failed_count_log1p", "external_succeeded_count_log1p", "external_failed_count_log1p", "tool_succeeded_count_log1p", "tool_failed_count_log1p", "child_succeeded_count_log1p", "child_failed_count_log1p", "unfinished_fact_count_log1p", "failed_fact_count_log1p", "succeeded_fact_count_log1p", "last_fact_failed", "last_fact_succeeded", "failure_recency", "successes_after_last_failure_log1p", "failures_after_last_success_log1p", "distinct_tool_count_log1p", "mandatory_fact_fraction", "goal_relevant_fact_fraction", "final_response_token_ratio", "recovery_token_ratio", "user_amendment_count_log1p", "requested_verification_count_log1p", "requested_side_effect_count_log1p", "constraint_count_log1p"]
NO_SUMMARY, NO_GOAL, NO_CRITERIA, NO_CONTEXT, CUT = "No textual summary was projected.", "Task intent unavailable from the authorized projection.", "Fulfill the active user request with observable evidence.", "No additional agent context was projected.", " …[truncated]"
GOAL_COUNTS = ["user_amendment", "requested_verification", "requested_side_effect", "constraint"]
SUMMARY = 2_000
BUDGET = 6_144


def tool_kind(tool: Column, facts: Column) -> Column:
    """What a tool's call is a fact of, by words that its name or its facts hold."""
    text = ascii_lower(F.concat_ws(" ", tool, facts))
    out = F.lit("tool_result")
    for kind, words in reversed(TOOL_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """The default counter: words by white space."""
    return F.when(trim_u(text) == "", 0).otherwise(F.coalesce(F.size(F.split(trim_u(text), r"(?U)\s+")), F.lit(0)))


def bounded(text: Column) -> Column:
    """A summary: at most ``SUMMARY`` characters, with a mark if it was longer."""
    t = trim_u(text)
    return F.when(t == "", NO_SUMMARY).when(F.char_length(t) > SUMMARY, F.concat(F.substring(t, 1, SUMMARY), F.lit(CUT))).otherwise(t)


def facts(spans: DataFrame, mappings: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(trace_id, ``sequence`` from 0, ``evidence_id``, span_id, actor, kind, status, tool_name, family, lane, mandatory, relevance, summary): the candidates of traces in their order.

    A failed call is one with an error or whose source says so. Failed calls, checks, changes, outside actions and calls without output are mandatory.
    """
    b = base(spans, with_text=True).kept()
    big = large_calls(b, limit)
    own = roots(b).select("trace_id", "root_id", F.col("_io._in").alias("_request"), F.col("_io._out").alias("_answer"))
    own = Scratch(spans.sparkSession, "completion").keep(own)
    null = F.lit(None).cast("string")
    c = call_rows(b, mappings)
    status = F.when(F.col("_io._failed"), "failed").when(F.col("_io._source") == "ok", "succeeded").otherwise("unknown")
    kind = tool_kind(F.col("tool_name"), F.col("_io._facts"))
    c = c.select("trace_id", F.col("pos").cast("long").alias("_at"), "span_id", F.lit("tool").alias("actor"), kind.alias("kind"), status.alias("status"), "tool_name", F.coalesce("_io._out", "_io._in").alias("_s"), F.col("_io._out").isNull().alias("_mute"))
    user = own.filter("_request is not null").select("trace_id", F.lit(-1).cast("long").alias("_at"), null.alias("span_id"), F.lit("user").alias("actor"), F.lit("user_request").alias("kind"), F.lit("succeeded").alias("status"), null.alias("tool_name"), F.col("_request").alias("_s"), F.lit(True).alias("_mute"))
    last = own.filter("_answer is not null").select("trace_id", F.lit(1 << 60).alias("_at"), null.alias("span_id"), F.lit("assistant").alias("actor"), F.lit("assistant_message").alias("kind"), F.lit("succeeded").alias("status"), null.alias("tool_name"), F.col("_answer").alias("_s"), F.lit(True).alias("_mute"))
    f = spread_join(c.unionByName(user).unionByName(last), own.select("trace_id", "_request"), ["trace_id"], "trace_id", big)
    summary = F.coalesce("_s", F.concat("tool_name", F.lit(" returned "), F.initcap("status")))
    mandatory = (F.col("actor") != "tool") | (F.col("status") == "failed") | F.col("kind").isin("verification", "artifact_mutation", "external_action") | F.col("_mute")
    f = f.withColumns({"mandatory": mandatory, "family": F.coalesce(ascii_lower(F.col("tool_name")), F.lit("trace")), "summary": summary})
    f = f.withColumns({"lane": F.when(F.col("kind") == "assistant_message", "final_response").when(mandatory, "mandatory").otherwise("goal_relevant"), "relevance": word_overlap(F.col("summary"), F.coalesce("_request", F.lit(NO_GOAL)))})
    f = running(f, "trace_id", "_at", {"_n": "cast(1 as bigint)"}, limit, big=big).withColumn("sequence", F.col("_n") - 1)
    evidence = F.concat(F.lit("E"), F.lpad(F.col("_n").cast("string"), 4, "0"))
    evidence = F.when(F.col("_n") > 9999, F.concat(F.lit("E"), F.col("_n").cast("string"))).otherwise(evidence)
    return f.select("trace_id", "sequence", evidence.alias("evidence_id"), "span_id", "actor", "kind", "status", "tool_name", "family", "lane", "mandatory", "relevance", "summary")


def recovery_chains(f: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(trace_id, family, failure_sequence, failure_evidence, success_sequence, success_evidence): each failed call and the first later success of its family, if any.

    The least of all later successes is a running minimum from the end.
    """
    x = f.filter("actor = 'tool'").select("trace_id", "family", "sequence", "evidence_id", "status", (-F.col("sequence")).alias("_o"), F.to_json(F.struct("trace_id", "family")).alias("_k"))
    x = running(x, "_k", "_o", {"_s": "case when status = 'succeeded' then struct(sequence, evidence_id) end"}, limit, how="min").filter("status = 'failed'")
    return x.select("trace_id", "family", F.col("sequence").alias("failure_sequence"), F.col("evidence_id").alias("failure_evidence"), F.col("_s.sequence").alias("success_sequence"), F.col("_s.evidence_id").alias("success_evidence"))


def _line() -> Column:
    return F.concat(F.lit("["), "evidence_id", F.lit("] actor="), "actor", F.lit(" kind="), "kind", F.lit(" status="), "status", F.lit(" tool="), escape_tagged(F.coalesce("tool_name", F.lit("none"))), F.lit(" summary="), escape_tagged(F.col("summary")))


def goal_text(request: Column) -> Column:
    head = F.concat(F.lit("Primary request: "), escape_tagged(F.coalesce(request, F.lit(NO_GOAL))))
    return F.concat(head, F.lit(f"\nSuccess criteria:\n- {NO_CRITERIA}\nRequested verification:\n- Unspecified.\nAgent context:\n- {NO_CONTEXT}"))


def projected(f: DataFrame, variant: str = "complete", budget: int = BUDGET, rubric: str = "", limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(facts, projections): the facts that a variant keeps within the budget, and one row a trace.

    facts: those of :func:`facts` with ``line``, ``n_tokens``. projections (trace_id, included_facts, omitted_facts, mandatory_facts, mandatory_facts_omitted,
    original_tokens, rubric_tokens, goal_tokens, final_response_tokens, mandatory_tokens, recovery_tokens, goal_relevant_tokens, metadata_tokens,
    projected_tokens, recovery_chains, ``fits``). The least relevant optional facts go first, of equal ones the earlier; facts of recoveries are
    protected where the variant shows recoveries. ``fits`` is false where what is protected exceeds the budget.
    """
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant}")
    scratch = Scratch(f.sparkSession, "projected")
    f = scratch.keep(f.withColumn("line", _line()).withColumn("n_tokens", tokens(F.col("line"))))
    chains = recovery_chains(f, limit).filter("success_sequence is not null")
    chains = scratch.keep(chains)
    part = chains.select("trace_id", F.explode(F.array("failure_sequence", "success_sequence")).alias("sequence")).distinct().withColumn("_rec", F.lit(True))
    x = f.join(part, ["trace_id", "sequence"], "left").withColumn("_rec", F.coalesce("_rec", F.lit(False)))
    keep = {"goal_and_final_response": (F.col("kind") == "user_request") | (F.col("lane") == "final_response"), "mandatory_evidence": F.col("mandatory"), "mandatory_with_recovery": F.col("mandatory") | F.col("_rec"), "complete": F.lit(True)}[variant]
    x = x.withColumn("_in", keep)
    if variant == "complete":
        # Of equal optional facts the first stays.
        free = ~F.col("mandatory") & ~F.col("_rec")
        first = x.filter(free).groupBy("trace_id", "family", "kind", "status", "summary").agg(F.max_by("sequence", F.struct("relevance", -F.col("sequence"))).alias("sequence")).select("trace_id", "sequence", F.lit(True).alias("_first"))
        x = x.join(first, ["trace_id", "sequence"], "left").withColumn("_in", ~free | F.coalesce("_first", F.lit(False))).drop("_first")
    if variant == "mandatory_with_recovery":
        x = x.withColumn("lane", F.when(~F.col("mandatory") & F.col("_rec"), "failure_recovery").otherwise(F.col("lane")))
    shows = variant in ("complete", "mandatory_with_recovery")
    x = scratch.keep(x)
    kept = x.filter("_in").select("trace_id", "sequence")
    lines = chains.join(kept.withColumnRenamed("sequence", "failure_sequence"), ["trace_id", "failure_sequence"], "left_semi").join(kept.withColumnRenamed("sequence", "success_sequence"), ["trace_id", "success_sequence"], "left_semi")
    # A chain's line has four words: its name, two facts, an arrow.
    n_chains = lines.groupBy("trace_id").agg(F.count(F.lit(1)).alias("recovery_chains"))
    goal = f.groupBy("trace_id").agg(F.max(F.when(F.col("kind") == "user_request", F.col("summary"))).alias("_g")).select("trace_id", (tokens(goal_text(F.col("_g"))) + 2).alias("goal_tokens"))
    of = lambda lane: F.coalesce(F.sum(F.when(F.col("_in") & (F.col("lane") == lane), F.col("n_tokens"))), F.lit(0))
    t = x.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("_in").alias("_kept"), F.count_if("mandatory").alias("mandatory_facts"), F.count_if(F.col("mandatory") & F.col("_in")).alias("_mand"), F.sum("n_tokens").alias("original_tokens"),
        (of("final_response") + 2).alias("final_response_tokens"), (of("mandatory") + 2).alias("mandatory_tokens"), (of("failure_recovery") + 2).alias("_rt"), (of("goal_relevant") + 2).alias("goal_relevant_tokens"),
    )
    t = t.join(goal, "trace_id").join(n_chains, "trace_id", "left").withColumns({"recovery_chains": F.coalesce("recovery_chains", F.lit(0)), "rubric_tokens": F.lit(2) + tokens(escape_tagged(F.lit(rubric))), "metadata_tokens": F.lit(5)})
    t = t.withColumn("recovery_tokens", F.col("_rt") + 4 * F.col("recovery_chains"))
    parts = ["rubric_tokens", "goal_tokens", "final_response_tokens", "mandatory_tokens", "recovery_tokens", "goal_relevant_tokens", "metadata_tokens"]
    t = scratch.keep(t.withColumn("_total", sum((F.col(p) for p in parts[1:]), F.col(parts[0]))).withColumn("_excess", F.greatest(F.col("_total") - budget, F.lit(0))))
    over = t.filter("_excess > 0").select("trace_id", "_excess")
    out = x.filter(F.col("_in"))
    gone = out.filter(~F.col("mandatory") & (~F.col("_rec") if shows else F.lit(True))).join(over, "trace_id")
    order = (F.least(F.col("relevance"), F.lit(1 << 20)).cast("long") * F.lit(1 << 42) + F.col("sequence")).alias("_o")
    gone = running(gone.select("trace_id", "sequence", "lane", "n_tokens", "_rec", "_excess", order), "trace_id", "_o", {"_sum": "cast(greatest(n_tokens, 1) as bigint)"}, limit)
    gone = scratch.keep(gone.filter(F.col("_sum") - F.greatest("n_tokens", F.lit(1)) < F.col("_excess")).select("trace_id", "sequence", "lane", "n_tokens"))
    out = out.join(gone.select("trace_id", "sequence"), ["trace_id", "sequence"], "left_anti")
    less = gone.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(F.when(F.col("lane") == lane, F.col("n_tokens"))), F.lit(0)).alias(f"_{lane}") for lane in ("goal_relevant", "failure_recovery")])
    t = t.join(less, "trace_id", "left").na.fill(0, ["_n", "_goal_relevant", "_failure_recovery"])
    lost = F.lit(0)
    if not shows:  # unprotected chains go with their facts
        cut = lines.join(gone.select("trace_id", F.col("sequence").alias("_q")), "trace_id").filter("_q = failure_sequence or _q = success_sequence").select("trace_id", "failure_sequence").distinct().groupBy("trace_id").agg(F.count(F.lit(1)).alias("_lost"))
        t = t.join(cut, "trace_id", "left").na.fill(0, ["_lost"])
        lost = F.col("_lost")
    t = t.withColumns({"goal_relevant_tokens": F.col("goal_relevant_tokens") - F.col("_goal_relevant"), "recovery_tokens": F.col("recovery_tokens") - F.col("_failure_recovery") - 4 * lost, "recovery_chains": F.col("recovery_chains") - lost})
    t = t.withColumn("projected_tokens", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    t = t.select("trace_id", (F.col("_kept") - F.col("_n")).alias("included_facts"), (F.col("_all") - F.col("_kept") + F.col("_n")).alias("omitted_facts"), "mandatory_facts", (F.col("mandatory_facts") - F.col("_mand")).alias("mandatory_facts_omitted"), "original_tokens", *parts, "projected_tokens", "recovery_chains", (F.col("projected_tokens") <= budget).alias("fits"))
    return out.drop("_in"), t


def prompts(f: DataFrame, projections: DataFrame, variant: str = "complete", rubric: str = "") -> DataFrame:
    """(trace_id, ``prompt``): the seven sections of projections that fit, from the facts and rows of :func:`projected`. A fitting prompt is bounded by its budget."""
    ok = projections.filter("fits")
    names = {"final_response": "final_response", "mandatory": "mandatory_evidence", "failure_recovery": "failure_recovery", "goal_relevant": "goal_relevant"}
    x = f.join(ok.select("trace_id"), "trace_id", "left_semi")
    lane = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lane") == k, F.struct("sequence", "line")))), lambda s: s["line"]), "\n")
    g = x.groupBy("trace_id").agg(*[lane(k).alias(f"_{k}") for k in names], F.max(F.when(F.col("kind") == "user_request", F.col("summary"))).alias("_g"))
    c = recovery_chains(x).filter("success_sequence is not null").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("failure_sequence", "failure_evidence", "success_evidence"))).alias("_c"))
    chain = F.array_join(F.transform("_c", lambda s, i: F.concat(F.lit("recovery-"), F.lpad((i + 1).cast("string"), 4, "0"), F.lit(": "), s["failure_evidence"], F.lit(" -> "), s["success_evidence"])), "\n")
    g = g.join(c, "trace_id", "left").join(ok, "trace_id").withColumn("_chains", F.coalesce(chain, F.lit("")))
    section = lambda tag, *body: F.concat(F.lit(f"<{tag}>\n"), F.concat_ws("\n", *body), F.lit(f"\n</{tag}>\n"))
    meta = F.concat(F.lit(f"<projection_metadata>variant={variant}; included_facts="), F.col("included_facts").cast("string"), F.lit("; original_facts="), (F.col("included_facts") + F.col("omitted_facts")).cast("string"), F.lit("; omitted_facts="), F.col("omitted_facts").cast("string"), F.lit("</projection_metadata>\nDecision:"))
    text = F.concat(section("rubric", escape_tagged(F.lit(rubric))), section("goal", goal_text(F.col("_g"))), section("final_response", F.col("_final_response")), section("mandatory_evidence", F.col("_mandatory")), section("failure_recovery", F.col("_failure_recovery"), F.col("_chains")), section("goal_relevant", F.col("_goal_relevant")), meta)
    return g.select("trace_id", text.alias("prompt"))


def features(f: DataFrame, projections: DataFrame, budget: int = BUDGET, goals: DataFrame | None = None) -> DataFrame:
    """One row a trace with the named features of its projection; ``f`` and ``projections`` from :func:`projected`. ``goals`` (trace_id, the counts of ``GOAL_COUNTS``) if known."""
    failed, won = F.col("status") == "failed", F.col("status") == "succeeded"
    last = f.groupBy("trace_id").agg(F.max(F.when(failed, F.col("sequence"))).alias("_lf"), F.max(F.when(won, F.col("sequence"))).alias("_ls"), F.max("sequence").alias("_end"))
    x = f.join(last, "trace_id")
    n = lambda c: F.count_if(c).cast("double")
    of = lambda kind, ok: n(ok & (F.col("kind") == kind))
    any_ = F.lit(True)
    g = x.groupBy("trace_id", "_lf", "_ls", "_end").agg(
        n(any_).alias("inc"), n(failed).alias("bad"), n(won).alias("ok"), n(F.col("status").isin("unknown", "running", "cancelled")).alias("open"), n(F.col("lane") == "final_response").alias("fin"),
        of("verification", won).alias("vs"), of("verification", failed).alias("vf"), of("verification", any_).alias("va"), of("artifact_mutation", won).alias("ms"), of("artifact_mutation", failed).alias("mf"), of("external_action", won).alias("es"), of("external_action", failed).alias("ef"),
        of("tool_result", won).alias("ts"), of("tool_result", failed).alias("tf"), of("child_agent_result", won).alias("cs"), of("child_agent_result", failed).alias("cf"), n(won & (F.col("sequence") > F.col("_lf"))).alias("sa"), n(failed & (F.col("sequence") > F.col("_ls"))).alias("fa"),
        F.count_distinct("tool_name").cast("double").alias("tools"), n(F.col("mandatory")).alias("mand"), n(F.col("lane") == "goal_relevant").alias("rel"),
        F.max(F.when(failed & (F.col("sequence") == F.col("_end")), 1.0).otherwise(0.0)).alias("lastf"), F.max(F.when(won & (F.col("sequence") == F.col("_end")), 1.0).otherwise(0.0)).alias("lasts"),
    )
    g = projections.join(g, "trace_id")
    if goals is not None:
        g = g.join(goals.groupBy("trace_id").agg(*[F.max(c).alias(c) for c in GOAL_COUNTS]), "trace_id", "left")
    col = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    share = lambda a, b: F.coalesce(col(a) / F.nullif(col(b), F.lit(0.0)), F.lit(0.0))
    log = lambda c: F.log1p(col(c))
    values = [
        log("included_facts"), log("omitted_facts"), F.coalesce(col("included_facts") / F.nullif(col("included_facts") + col("omitted_facts"), F.lit(0.0)), F.lit(0.0)), col("projected_tokens") / float(budget), share("projected_tokens", "original_tokens"), (F.col("fin") > 0).cast("double"), log("recovery_chains"), share("recovery_chains", "bad"),
        share("bad", "inc"), share("ok", "inc"), share("open", "inc"), log("vs"), log("vf"), (F.col("va") == 0).cast("double"), log("ms"), log("mf"), log("es"), log("ef"), log("ts"), log("tf"), log("cs"), log("cf"), log("open"), log("bad"), log("ok"), F.col("lastf"), F.col("lasts"),
        share("_lf", "_end"), log("sa"), log("fa"), log("tools"), share("mand", "inc"), share("rel", "inc"), share("final_response_tokens", "projected_tokens"), share("recovery_tokens", "projected_tokens"),
        *[log(c) if goals is not None else F.lit(0.0) for c in GOAL_COUNTS],
    ]
    return g.select("trace_id", *[v.alias(k) for k, v in zip(FEATURES, values)])
