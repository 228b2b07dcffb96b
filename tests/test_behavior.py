import hashlib
import random

from pyspark.sql import functions as F

from spanwright.operators import behavior as B
from spanwright.operators import detectors as D
from spanwright.operators import findings as G

SPAN = "trace_id string, pos bigint, id string, parent_id string, name string, kind string, input string, output string, error string, started_at string, ended_at string, source_status string, attributes map<string,string>, ingested_at timestamp"


def span(t, pos, i, kind="tool", parent="root", error=None, status="unset", start=None, end=None, inp=None, out=None, **attrs):
    return (t, pos, i, parent, f"n{pos}", kind, inp, out, error, start, end, status, {k.replace("__", "."): v for k, v in attrs.items()}, None)


def call(t, pos, op, **kw):
    base = dict(gen_ai__tool__name=op.title(), agent__operation=op, agent__operation__effect=kw.pop("effect", "read_only"), agent__tool__requirement=kw.pop("need", "required"), agent__operation__retry_safety=kw.pop("retry", "idempotent"))
    return span(t, pos, f"{t}-{pos}", **(base | kw))


def frame(spark, rows):
    return spark.createDataFrame(rows, SPAN).withColumn("note", F.lit("x")).withColumn("idx", F.lit(9))


def labelled():
    root = lambda t, **a: span(t, 0, f"{t}-root", "agent", None, **a)
    return [
        # fails, then the same operation succeeds
        root("good", agent__final__status="completed", agent__outcome__claims='[{"operation":"look","status":"succeeded"}]'),
        call("good", 1, "look", error="temporary network failure"),
        call("good", 2, "look", agent__tool__status="succeeded", agent__state__observation="verified_unchanged", agent__state__predicate="seen"),
        # times out, state unclear, yet success is claimed
        root("bad", agent__final__status="completed", agent__outcome__claims='[{"operation":"cancel","call_id":"c-1","status":"succeeded"}]'),
        call("bad", 1, "cancel", error="request timed out", effect="mutating", retry="non_idempotent", gen_ai__tool__call__id="c-1", agent__state__observation="ambiguous", agent__state__predicate="gone"),
        # fails by its structured result, and says so
        root("honest", agent__final__status="failed", agent__outcome__claims='[{"operation":"set","status":"not_completed"}]'),
        call("honest", 1, "set", effect="mutating", tool__result__success="false", agent__state__observation="conflicting", agent__state__predicate="set"),
        root("open", agent__final__status="incomplete"),
        call("open", 1, "look", agent__tool__status="succeeded"),
    ]


def test_labelled_traces(spark):
    rows = labelled()
    f = D.Facts.of(frame(spark, rows + [rows[1]]))
    found = D.detect(f).collect()
    assert sorted((r["trace_id"], r["detector_id"]) for r in found) == [("bad", "false_success_claim"), ("bad", "terminal_tool_failure"), ("bad", "uncertain_mutation_state"), ("open", "missing_resolution")]
    rec = {(r["trace_id"], r["idx"]): r["recovery"] for r in f.recovery().collect()}
    assert rec == {("good", 0): "unknown", ("good", 1): "recovered", ("bad", 0): "unrecovered", ("honest", 0): "recovered", ("open", 0): "recovered"}
    one = next(r for r in found if r["detector_id"] == "terminal_tool_failure")
    assert one["evidence"] == ["span:bad-1", "state_change:bad-1"]

    def framed(*parts):
        return "sha256:" + hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()

    assert one["finding_id"] == framed("bad", "terminal_tool_failure", "6", "span:bad-1", "state_change:bad-1")
    assert one["failure_signature"] == framed("terminal_tool_failure", "Cancel", "cancel", "timeout")
    groups = G.signature_groups(D.detect(f)).collect()
    assert len(groups) == 4 and all(g["occurrence_count"] == 1 for g in groups)
    texts = G.projections(D.detect(f)).collect()
    assert len(texts) == 4 and not any("timed out" in t["text"] for t in texts)


def test_status_precedence(spark):
    rows = [
        ("failed", dict(tool__result__success="false", error="timed out")), ("timed_out", dict(error="Timed Out")), ("unknown", dict(agent__tool__status="timed_out")) , ("cancelled", dict(agent__tool__status="cancelled")),
        ("failed", dict(status="error")), ("failed", dict(exception__type="E")), ("failed", dict(error="")), ("failed", dict(http__status_code="503")), ("unknown", dict(agent__tool__status="uncertain", status="ok")),
        ("succeeded", dict(status="ok")), ("succeeded", dict(agent__tool__status="OK")), ("succeeded", dict(out='{"ok": true}')), ("failed", dict(out='{"error": "x"}')), ("succeeded", dict(out='{"error": null}')), ("unknown", dict(out="plain")), ("unknown", {}),
    ]
    df = frame(spark, [call("t", i, "op", **dict(kw)) for i, (_, kw) in enumerate(rows)])
    got = [r["status"] for r in B.calls(df).orderBy("pos").collect()]
    assert got == [w for w, _ in rows]


def episodes(calls, most, window):
    """Places of repeated failures by a plain fold."""
    active, out = {}, []

    def flush():
        out.extend(v for v in active.values() if len(v) >= most)
        active.clear()

    for i, (key, ok) in enumerate(calls):
        if ok:
            flush()
        elif key:
            if key in active and i - active[key][0] >= window:
                v = active.pop(key)
                if len(v) >= most:
                    out.append(v)
            active.setdefault(key, []).append(i)
    flush()
    return sorted((v[0], v[-1], len(v)) for v in out)


def loops(keys, n):
    """The loop of each stretch without progress that ends first."""
    out, seg = [], []
    for i, k in enumerate([*keys, None]):
        if k is not None:
            seg.append((i, k))
            continue
        best = None
        for end in range(len(seg)):
            at = [j for j in range(end + 1) if seg[j][1] == seg[end][1]][-n:]
            if len(at) == n and len({tuple(x[1] for x in seg[a + 1 : b]) for a, b in zip(at, at[1:])}) == 1:
                best = (seg[at[0]][0], seg[end][0], at[1] - at[0])
                break
        if best:
            out.append(best)
        seg = []
    return sorted(out)


def test_episodes_and_loops_against_plain_folds(spark):
    r = random.Random(6)
    rows, want_e, want_l = [], {}, {}
    for t in ("a", "b", "c"):
        seq = [(r.choice("xyz"), r.random() < 0.06) for _ in range(90)]
        rows += [call(t, i, k, inp=f'{{"q": "{k}"}}', error=None if ok else "boom", **({"status": "ok"} if ok else {})) for i, (k, ok) in enumerate(seq)]
        want_e[t] = episodes(seq, 3, 8)
        prog = r.sample(range(90), 5)
        want_l[t] = seq, prog
    f = D.Facts.of(frame(spark, rows))
    got = {}
    for e in D.failure_episodes(f, D.Limits()).collect():
        got.setdefault(e["trace_id"], []).append((e["first_idx"], e["last_idx"], e["n"]))
    assert {k: sorted(v) for k, v in got.items()} == want_e
    found = {}
    for e in D.loops(f, D.Limits(loop_calls=3)).collect():
        found.setdefault(e["trace_id"], []).append((e["first_idx"], e["last_idx"], e["cycle_length"]))
    assert {k: sorted(v) for k, v in found.items()} == {t: loops([k for k, _ in s], 3) for t, (s, _) in want_l.items()}
    tiny = D.Facts.of(frame(spark, rows), limit=20)  # every trace counts as huge
    for n in (2, 3, 4):
        plain = sorted(map(tuple, D.loops(f, D.Limits(loop_calls=n)).collect()))
        assert plain == sorted(map(tuple, D.loops(tiny, D.Limits(loop_calls=n), 20).collect())) == sorted((t, *x) for t, (s, _) in want_l.items() for x in loops([k for k, _ in s], n)), n
    assert sorted(map(tuple, f.recovery().collect())) == sorted(map(tuple, tiny.recovery().collect()))
    assert D.repeated_tool_failure(f, D.Limits()).count() == sum(map(len, want_e.values()))


def test_policy_and_budget(spark):
    rows = [
        span("p", 0, "root", "agent", None, agent__escalation__status="required_and_missing", agent__final__status="completed"),
        span("p", 1, "d1", "guardrail", agent__policy__outcome="denied", policy__action="pay", policy__id="v1"), span("p", 2, "d2", "guardrail", agent__policy__outcome="required", policy__action="escalate_now"),
        call("p", 3, "pay", status="ok", agent__approval__required="true", agent__approval__outcome="denied"), call("p", 4, "look", status="ok", agent__approval__required="true", agent__approval__outcome="allowed"),
    ]
    f = D.Facts.of(frame(spark, rows))
    kinds = sorted(r["detector_id"] for r in D.detect(f, None, D.Limits(tool_calls=1)).collect())
    assert kinds == ["approval_bypass", "excessive_tool_usage", "policy_violation", "unresolved_escalation"]
    cover = {r["detector_id"]: r["status"] for r in D.detector_coverage(f).collect()}
    assert cover["policy_violation"] == "evaluated" and cover["excessive_tool_usage"] == "inconclusive"


def test_empty_and_null(spark):
    f = D.Facts.of(frame(spark, []))
    assert D.detect(f).count() == 0 and D.detector_coverage(f).count() == 0
    odd = [("t", 1, "s", None, None, None, None, None, None, None, None, None, None, None), (None, 1, "s", None, None, "tool", None, None, None, None, None, None, None, None), ("t", 2, None, None, None, "tool", None, None, None, None, None, None, None, None)]
    g = D.Facts.of(frame(spark, odd))
    assert [r["detector_id"] for r in D.detect(g).collect()] == ["missing_resolution"]


def test_recurrence(spark):
    cols = "finding_id string, detector_id string, trace_id string, severity string, failure_signature string, created_at string"
    b = spark.createDataFrame([("1", "d", "t1", "high", "s1", "a"), ("2", "d", "t1", "low", "s1", "a"), ("2", "d", "t1", "low", "s1", "a"), ("3", "d", "t2", "high", "s2", "b")], cols)
    c = spark.createDataFrame([("4", "d", "t9", "critical", "s3", "c"), ("5", "d", "t8", "low", "s4", "c")], cols)
    r = G.recurrence(b, c, b.select("failure_signature").filter("failure_signature = 's1'"), (4, 0)).first()
    assert (r["baseline_occurrence_count"], r["baseline_affected_trace_count"], r["baseline_recurrence_rate"], r["candidate_recurrence_rate"], r["severe_novel_count"], r["evidence_complete"]) == (2, 1, 0.25, None, 1, False)
