import base64
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwright.cli import main
from spanwright.functions import canonical as J
from spanwright.functions import text as X
from spanwright.operators import cluster as C
from spanwright.operators import extract, taxonomy
from spanwright.operators.slices import running
from spanwright.sources import files
from spanwright.streaming.runner import FindingSink, run_detection

TRACES = [
    {"id": "t1", "metadata": {"project": "demo", "n": 3}, "spans": [
        {"id": "r", "name": "agent", "kind": "other", "input": "Where is my crate?", "output": "On its way.", "attributes": {"openinference.span.kind": "AGENT", "agent.final.status": "completed", "x": 1.5, "project": "span"}},
        {"id": "c", "parent_id": "r", "name": "find", "kind": "tool", "error": "timed out", "attributes": {"agent.tool.requirement": "required"}, "unknown": [1]}]},
    {"id": "t2", "spans": []},
]


@pytest.fixture
def traces(tmp_path):
    p = tmp_path / "traces.jsonl"
    p.write_text("\n".join(json.dumps(t) for t in TRACES) + "\n\n  \n", encoding="utf-8")
    return str(p)


def test_traces_and_cases(spark, traces):
    spans, meta = files.read_traces(spark, traces)
    got = spans.orderBy("pos").collect()
    assert [(r["trace_id"], r["pos"], r["id"], r["kind"], r["source_status"]) for r in got] == [("t1", 0, "r", "other", "unset"), ("t1", 1, "c", "tool", "unset")]
    assert got[0]["attributes"]["x"] == "1.5" and meta.count() == 2
    c = extract.openinference_cases(spans, meta).collect()
    assert len(c) == 1 and (c[0]["id"], c[0]["input"], c[0]["actual_output"]) == ("t1:r", "Where is my crate?", "On its way.")
    m = c[0]["metadata"]
    assert m["project"] == "demo" and m["source_span_id"] == "r" and json.loads(m["tool_calls"])[0]["span_id"] == "c"
    assert extract.simple_cases(spans).first()["id"] == "t1:r"


def test_bad_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a"}\nnot json\n{"id": 1}\n[1]\n')
    good, bad = files.read_jsonl_lenient(spark, str(p), files.CASE)
    assert [r["id"] for r in good.collect()] == ["a", "1"] and sorted(r["line"] for r in bad.collect()) == ["[1]", "not json"]
    with pytest.raises(Exception, match="not a record"):
        files.read_jsonl(spark, str(p), files.CASE).collect()


def test_exports(spark, tmp_path):
    c = spark.createDataFrame([("a", "t", 'say "hi"\nnow', None, "x", None, {"k": "v"})], files.CASE)
    files.write_cases_csv(c, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back["input"], back["expected_output"]) == ('say "hi"\nnow', "x")
    assert files.openai_eval_rows(c).first()["ideal"] == "x"
    files.write_promptfoo(c, str(tmp_path / "p.json"))
    test = json.loads((tmp_path / "p.json").read_text())["tests"][0]
    assert test["assert"] == [{"type": "contains", "value": "x"}] and test["metadata"]["rubric"] is None
    files.write_jsonl(c, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), files.CASE).first()["metadata"] == {"k": "v"}
    p = tmp_path / "d.jsonl"
    p.write_text("a\n\nb\n")
    d = files.artifact_digest(spark, str(p)).first()
    assert (d["sha256"], d["byte_count"], d["record_count"]) == ("sha256:" + hashlib.sha256(b"a\n\nb\n").hexdigest(), 5, 2)


def test_command_line(spark, traces, tmp_path, monkeypatch):
    monkeypatch.setattr("spanwright.cli.local_session", lambda **k: spark)
    assert main(["detect", "--traces", traces, "--out", str(tmp_path / "f"), "--groups", str(tmp_path / "g"), "--packet", str(tmp_path / "p.json")]) == 0
    found = [json.loads(x) for p in (tmp_path / "f").glob("part*") for x in p.read_text().splitlines()]
    assert {x["detector_id"] for x in found} == {"terminal_tool_failure"} and json.loads((tmp_path / "p.json").read_text())["trace_count"] == 1
    members = [json.loads(x) for p in (tmp_path / "p.json.members").glob("part*") for x in p.read_text().splitlines()]
    assert [x["id"] for x in members if x["kind"] == "trace"] == ["t1"]
    assert main(["extract", "--traces", traces, "--out", str(tmp_path / "c"), "--extractor", "openinference"]) == 0
    assert main(["validate", "--cases", str(tmp_path / "c"), "--out", str(tmp_path / "v")]) == 0


def test_stream_replays_add_nothing(spark, tmp_path):
    rows = [("t1", 0, "r", None, "agent", "agent", None, None, None, None, None, None, {"agent.final.status": "incomplete"})]
    cols = "trace_id string, pos bigint, id string, parent_id string, name string, kind string, input string, output string, error string, started_at string, ended_at string, source_status string, attributes map<string,string>"
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(tmp_path / "in"))
    _, one = run_detection(spark, str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "c1"))
    _, two = run_detection(spark, str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "c2"))  # a new checkpoint: everything again
    _, three = run_detection(spark, str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "c1"))
    assert (one.written, two.written, two.skipped, three.batches) == (1, 0, 1, 0)
    assert FindingSink(spark, str(tmp_path / "sink")).read().count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([(" \tÉA x ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.trim_u(F.col("t"))).collect()] == ["ÉA x", "", None]
    assert df.select(X.ascii_lower(F.col("t"))).first()[0] == " \tÉa x "
    for n in range(0, 9):
        got = spark.createDataFrame([("aé日😀",)], "t string").select(X.truncate_utf8(F.col("t"), n)).first()[0]
        assert got == "aé日😀".encode()[:n].decode(errors="ignore")
    j = spark.createDataFrame([('{"b": 1, "a": [true, null]}',), ("nope",)], "t string").select(X.canonical_json(F.col("t"))).collect()
    assert [r[0] for r in j] == ['{"a":[true,null],"b":1}', None]
    s = ["token: abcdef123", base64.b64encode(b"my password = hunter22 here").decode(), "plain words", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in s], "t string").select(X.leaks_secret(F.col("t"))).collect()] == [True, True, False, False]
    assert spark.range(1).select(X.normalized_score(F.lit(3.0), F.lit("four_point"))).first()[0] == pytest.approx(2 / 3)


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_round_trip(x):
    assert float(J.number(x)) == x


def test_canonical():
    assert J.text({"b": 1.0, "a": [1e21, 1e-7, 0.1, -0.0, "é\n"], "€": None}) == '{"a":[1e+21,1e-7,0.1,0,"é\\n"],"b":1,"€":null}'
    assert J.content_id("d", {}) == "sha256:" + hashlib.sha256(b"d{}").hexdigest()


def test_running_with_slices(spark):
    rows = [(k, i, i % 3) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o bigint, x int")
    for limit in (1000, 7):
        got = {(r["k"], r["o"]): (r["n"], r["s"]) for r in running(df, "k", "o", {"n": "cast(1 as bigint)", "s": "x"}, limit).collect()}
        assert got == {(k, i): (i + 1, sum(j % 3 for j in range(i + 1))) for k in "ab" for i in range(50)}


def test_taxonomy_and_maps(spark):
    n = spark.createDataFrame([("a", None, "x"), ("b", "a", "x"), ("c", "z", "x"), ("d", "e", "x"), ("e", "d", "x"), ("f", "a", "y"), ("a", None, "x")], "node_id string, parent_id string, dimension string")
    codes = sorted((r["code"], r["node_id"]) for r in taxonomy.validate(n).collect())
    assert codes == [("cycle", "d"), ("cycle", "e"), ("duplicate_node", "a"), ("parent_of_another_dimension", "f"), ("unknown_parent", "c")]
    cat = spark.createDataFrame([("abcdef0123456",), ("abcdef0123457",), ("ffff",)], "identity string")
    got = {r["prefix"]: (r["identity"], r["matches"]) for r in taxonomy.resolve_prefix(spark.createDataFrame([("abcdef0123456",), ("abcdef012345",), ("ab",)], "prefix string"), cat).collect()}
    assert got == {"abcdef0123456": ("abcdef0123456", 1), "abcdef012345": (None, 2), "ab": (None, 0)}
    m = C.row_map(spark.createDataFrame([("z",), ("a",), ("m",), ("a",), (None,)], "e string"), "e").orderBy("row_id").collect()
    assert [(r["row_id"], r["external_id"]) for r in m] == [(0, "a"), (1, "m"), (2, "z")]
    with pytest.raises(NotImplementedError):
        C.dbscan()
