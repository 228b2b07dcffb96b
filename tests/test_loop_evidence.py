"""Findings of loops hold all calls of the loop, and their ids are over all of them."""

import hashlib

from pyspark.sql import functions as F
from test_behavior import call, frame, span

from spanwright.functions.text import hash_parts
from spanwright.operators import detectors as D


def framed(*parts):
    return "sha256:" + hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()


def test_long_loop(spark):
    cycle = 3_400  # from the first call to its fourth return: more than 10,000 calls
    rows = [span("long", 0, "root", "agent", None, agent__final__status="failed"), *(call("long", 1 + i, "look", inp=f'{{"q": {i % cycle}}}') for i in range(4 * cycle))]
    rows += [span("short", 0, "root", "agent", None), *(call("short", 1 + i, "see" if i % 2 else "look", inp='{"q": "x"}', **({"agent__state__artifact__id": "a", "agent__state__observation": "ambiguous"} if i % 2 else {})) for i in range(9))]
    got = {r["trace_id"]: r for r in D.detect(D.Facts.of(frame(spark, rows)), ["tool_call_loop"]).collect()}
    want = {"long": sorted(f"span:long-{1 + i}" for i in range(3 * cycle + 1)), "short": sorted(["state_artifact:a", *(f"span:short-{1 + i}" for i in range(7))])}
    assert {t: r["evidence"] for t, r in got.items()} == want
    assert {t: r["finding_id"] for t, r in got.items()} == {t: framed(t, "tool_call_loop", "6", *e) for t, e in want.items()}
    assert {t: (r["subject"], r["operation"], r["recovery"], r["metadata"]["cycle_length"]) for t, r in got.items()} == {"long": ("Look", "look", "unrecovered", str(cycle)), "short": ("Look", "look", "unknown", "2")}


def test_hash_of_many_parts(spark):
    some = [[], [""], ["é", None, "x" * 300], [f"span:{i}" for i in range(100_000)]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(some)], "i int, m array<string>")
    got = [r["h"] for r in df.orderBy("i").select(hash_parts(F.lit("a"), more=F.col("m")).alias("h")).collect()]
    assert got == [framed("a", *(p or "" for p in m)) for m in some]
