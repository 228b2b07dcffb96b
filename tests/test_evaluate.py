import random

import numpy as np
from pyspark.sql import functions as F

from spanwright.operators import cluster as C
from spanwright.operators import compare as X
from spanwright.operators import evaluate as E
from spanwright.operators import stats as T
from spanwright.operators import verify as V

RESULT = "case_id string, trace_id string, evaluator_name string, raw_score double, normalized_score double, score_scale string, calibrated_score double, passed boolean, cluster_id string"


def results(spark, rows):
    return spark.createDataFrame(rows, RESULT).withColumn("_w", F.lit(7)).withColumn("note", F.lit("x"))


def test_weights_and_calibration(spark):
    r = results(spark, [("a", "t", "e", 1.0, 1.0, "unit", None, True, "one"), ("b", "t", "e", 0.0, 0.0, "unit", None, False, "three")]).drop("_w")
    w = spark.createDataFrame([("one", 1.0), ("three", 3.0)], "id string, weight double")
    assert E.score(r, None, w).first()["weighted_score"] == 0.25
    assert E.score(r.limit(0)).first()["weighted_score"] == 0.0
    ratings = spark.createDataFrame([("a", 4), ("b", 3), ("b", 1)], "case_id string, score int").withColumn("ord", F.monotonically_increasing_id())
    x = results(spark, [("a", "t", "e", 1.0, 1.0, "unit", None, True, None), ("b", "t", "e", 1.0, 1.0, "unit", None, True, None), ("c", "t", "e", 0.2, 0.2, "unit", None, True, None)])
    bins, model = E.fit_calibration(x, ratings)
    assert [(b["bin_key"], b["n"], b["pass_rate"], b["mean_human"]) for b in bins.collect()] == [(1000, 2, 0.5, 0.5)]
    m = model.first()
    assert (m["n"], m["global_pass_rate"], m["mean_absolute_error"], m["evaluator_name"]) == (2, 0.5, 0.5, "e")
    assert {r["case_id"]: r["calibrated_score"] for r in E.calibrated(x, bins).collect()} == {"a": 0.5, "b": 0.5, "c": 0.5}
    i = E.calibration_impact(E.calibrated(x, bins)).first()
    assert round(i["delta"], 4) == round(0.5 - 2.2 / 3, 4)
    assert E.calibration_impact(x).count() == 0


def test_binary_report(spark):
    rows = [(0.9, True), (0.8, False), (0.2, True), (0.1, False), (None, True)]
    p = spark.createDataFrame(rows, "p double, label boolean")
    c = T.rates(T.confusion(p)).first()
    assert (c["attempted"], c["decided"], c["tp"], c["fp"], c["tn"], c["fn"]) == (5, 4, 1, 1, 1, 1)
    assert (c["precision"], c["recall"], c["f1"], c["mcc"]) == (0.5, 0.5, 0.5, 0.0)
    assert abs(c["precision_lower"] - 0.0945312057) < 1e-9 and abs(c["precision_upper"] - 0.9054687943) < 1e-9
    s = T.selective_risk(p).orderBy("decided_count").collect()
    assert s[0]["classification_risk"] is None and s[-1]["coverage"] == 0.8
    tie = spark.createDataFrame([(0.5, True), (0.5, False)], "p double, label boolean")
    assert T.precision_recall_areas(tie).first()["average_precision"] == 0.5
    assert T.reliability_bins(p, 4).count() == 4 and T.confusion(p.limit(0)).first()["tp"] == 0
    empty = T.rates(T.confusion(p.limit(0))).first()
    assert empty["precision"] is None and empty["mcc"] is None


def test_bootstrap_spans_all_or_nothing():
    lo, hi, valid = T.bootstrap_macro_f1(np.array([[1, 0, 1, 0], [0, 1, 0, 1]]), 2000)
    assert (lo, hi, valid) == (0.0, 1.0, 2000)
    assert T.bootstrap_macro_f1(np.zeros((0, 4), np.int64)) is None
    # the first outputs of the public generator for state 0
    with np.errstate(over="ignore"):
        x = T._mix(np.uint64(0) + np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert [int(v) for v in x] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]


def test_agreement(spark):
    same = spark.createDataFrame([(f"i{k}", r, "ab"[k % 2]) for k in range(6) for r in "xy"], "item_id string, rater_id string, label string")
    assert T.agreement(same).first()["krippendorff_alpha"] == 1.0
    k = T.two_rater_kappas(same, ["a", "b"]).first()
    assert (k["cohen_kappa"], k["weighted_kappa"]) == (1.0, 1.0)
    three = same.unionByName(spark.createDataFrame([("i0", "z", "b")], same.schema))
    assert T.two_rater_kappas(three, ["a", "b"]).first()["cohen_kappa"] is None


def test_logistic_separates(spark):
    r = random.Random(1)
    rows = [(i, x, r.random(), x + r.gauss(0, 0.3) > 0.5) for i in range(400) for x in [r.random()]]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, y boolean")
    m = T.fit_logistic(df, ["a", "b"], "y", "k")
    assert m.coefficients[0] > 5 * abs(m.coefficients[1]) and m.rounds < 50
    p = m.predict(df).groupBy("y").agg(F.avg("p").alias("p")).orderBy("y").collect()
    assert p[1]["p"] > p[0]["p"] + 0.3


def test_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 12)) + np.repeat(np.eye(12)[:6] * 6, 50, 0)
    df = spark.createDataFrame([(i, [float(v) for v in row], i // 50) for i, row in enumerate(x)] + [(900, None, 0)], "id bigint, v array<double>, l int").withColumn("distance", F.lit(1))
    q = df.filter("id % 100 = 0")
    for metric in ("cosine", "euclidean", "negative_inner_product"):
        want = C.distances(x[[0, 100, 200]], x, metric)
        got = C.top_k(q, df, "id", "v", 4, metric).orderBy("query_id", "rank").collect()
        assert [g["hit_id"] for g in got] == np.argsort(want, 1, kind="stable")[:, :4].ravel().tolist()
    few = C.top_k(q, df, "id", "v", 2, allowed=df.filter("id in (7, 8, 9)"))
    assert {g["hit_id"] for g in few.collect()} <= {7, 8, 9}
    exact = {(g["query_id"], g["hit_id"]) for g in C.top_k(q, df, "id", "v", 10).collect()}
    ivf = {(g["query_id"], g["hit_id"]) for g in C.InvertedLists(df, "id", "v", lists=6).search(q, 10, probes=3).collect()}
    assert len(exact & ivf) >= 0.9 * len(exact)
    d = C.distances(x, x, "cosine")
    lab = np.arange(300) // 50
    want = []
    for i in range(300):
        a = d[i][(lab == lab[i]) & (np.arange(300) != i)].mean()
        b = min(d[i][lab == k].mean() for k in range(6) if k != lab[i])
        want.append((b - a) / max(a, b))
    got = {g["l"]: g["silhouette"] for g in C.silhouettes(df, "id", "v", "l").collect()}
    assert all(abs(got[k] - np.mean(np.array(want)[lab == k])) < 1e-9 for k in range(6))
    model, assigned = C.discover(df, "id", "v", 6)
    sizes = [m["size"] for m in model.orderBy("id").collect()]
    assert sum(sizes) == 300 and sizes == sorted(sizes, reverse=True) and assigned.count() == 300
    near = C.nearest_centroid(df, "id", "v", model, threshold=-1.0)
    assert near.filter("novelty and cluster_id = 'unclustered'").count() == 300


def test_rules(spark):
    cases = spark.createDataFrame([("a", "t", "lost parcel", None, None, None, {"cluster_id": " B "}), ("b", "t", "The FEE of a parcel depot", None, None, None, {}), ("c", "t", "nothing", None, None, None, None)], "id string, trace_id string, input string, actual_output string, expected_output string, rubric string, metadata map<string,string>")
    k = spark.createDataFrame([(0, "A", "fee", (None, ["cost"])), (1, "B", "parcel", ("b-tag", ["depot", "hub"]))], "ord bigint, id string, label string, metadata struct<tag:string,keywords:array<string>>")
    got = {r["case_id"]: (r["cluster_id"], round(r["confidence"], 2), r["method"]) for r in C.assign_by_rules(cases, k).collect()}
    assert got == {"a": ("B", 1.0, "metadata"), "b": ("B", 0.7, "keyword"), "c": ("unclustered", 0.0, "fallback")}


def test_pairing_and_gates(spark):
    cols = "case_id string, evaluator_name string, evaluator_version string, normalized_score double, passed boolean"
    b = spark.createDataFrame([("a", "e", "1", 1.0, True), ("a", "f", None, 0.5, True), ("b", "e", "1", 0.0, False), ("b", "e", "1", 0.0, False)], cols)
    c = spark.createDataFrame([("a", "e", "1", 0.25, False), ("a", "f", None, 0.5, True), ("d", "e", "1", 1.0, True)], cols)
    p = {(r["case_id"], r["evaluator_name"]): r for r in V.paired_results(b, c).collect()}
    assert {k: r["pairing"] for k, r in p.items()} == {("a", "e"): "paired", ("a", "f"): "paired", ("b", "e"): "missing_candidate", ("d", "e"): "unexpected_candidate"}
    assert p[("a", "e")]["score_delta"] == -0.75 and p[("b", "e")]["baseline_rows"] == 2
    g = {r["case_id"]: r["passed"] for r in V.case_gates(V.paired_results(b, b.dropDuplicates())).collect()}
    assert g == {"a": False, "b": False}
    s = V.suite_gate(V.paired_results(b.filter("evaluator_name = 'e' and case_id = 'a'"), c), b.select("case_id").filter("case_id = 'a'")).first()
    assert (s["regressed_results"], s["largest_drop"], s["passed"]) == (1, 0.75, False)
    assert V.budget_gate({"tool_calls": 3}, {"tool_calls": 4}, {"tool_calls": 0})["passed"] is False


def test_validation(spark):
    cases = spark.createDataFrame([("a", "t", "q", None), ("a", "t", "q", "x"), (" ", "t", "", "x"), (None, None, None, None)], "id string, trace_id string, input string, actual_output string")
    got = {(r["severity"], r["code"]): r["n"] for r in V.report(V.validate_cases(cases, draft=True)).collect()}
    assert got == {("error", "missing_case_id"): 2, ("error", "duplicate_case_id"): 1, ("error", "missing_trace_id"): 1, ("error", "missing_input"): 2, ("warning", "missing_actual_output"): 2}
    e = spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0]), ("z", None)], "case_id string, vector array<double>")
    codes = {r["code"] for r in V.validate_embeddings(e, cases).collect()}
    assert codes == {"duplicate_embedding", "mixed_embedding", "invalid_embedding", "missing_embedding", "unknown_embedding_case"}


def test_alignment():
    p = lambda a, b, n=32: list(X.pairs_of(list(a), list(b), n))
    assert p("abc", "abc") == [("same", i, i) for i in range(3)]
    assert [x[0] for x in p("abc", "abxc")] == ["same", "same", "candidate_only", "same"]
    assert [x[0] for x in p("abxc", "abc")] == ["same", "same", "baseline_only", "same"]
    assert [x[0] for x in p("ax", "ay")] == ["same", "changed"]
    assert [x[0] for x in p("ab", "ba")] == ["candidate_only", "same", "baseline_only"]
    import pandas as pd

    def side(keys, last):
        return pd.DataFrame({"key": keys, "span_id": [f"s{i}" for i in range(len(keys))], "status": ["ok"] * (len(keys) - 1) + [last], "facts": "", "root": False})

    n = 10_001
    got = X.aligned(side(["k"] * n, "ok"), side(["k"] * n, "error"), context=3, most=8)
    assert len(got) == 4 and got["common_prefix_steps"].iloc[0] == n - 1 and got["relation"].iloc[-1] == "changed" and not got["truncated"].any()


def test_ratings_count_in_any_spelling(spark, tmp_path):
    from spanwright.plans import evaluation, statistics

    def tables(name, spelt):
        rows = [("i", "a", "harmful", 1), ("i", "a", spelt[0], 2), ("i", "b", spelt[1], 1), ("j", "a", spelt[2], 1), ("j", "b", "harmful", 1), ("k", "a", "Harmful" if spelt[0] != "resolved" else "harmful", 1), ("k", "b", "harmful", 2), ("k", "b", "solved", 3)]
        spark.createDataFrame(rows, "item_id string, rater_id string, label string, rated_at long").selectExpr("item_id", "rater_id", "label", "timestamp_seconds(rated_at) as rated_at").write.parquet(f"{tmp_path}/{name}/agreement_ratings.parquet")
        results(spark, [(c, "t", "prompt_judge", x, x, "unit", None, True, None) for c, x in (("i", 0.9), ("j", 0.4), ("k", 0.1))]).write.parquet(f"{tmp_path}/{name}/eval_results.parquet")
        return f"{tmp_path}/{name}"

    clean, dirty = tables("clean", ["resolved", "partly_resolved", "unresolved"]), tables("dirty", [" Resolved", "partly-resolved", "UNRESOLVED\t"])
    assert sorted(map(tuple, statistics._ratings(spark, dirty).collect())) == [("i", "a", "resolved"), ("i", "b", "partly_resolved"), ("j", "a", "unresolved"), ("j", "b", "harmful"), ("k", "a", "harmful"), ("k", "b", "harmful")]
    for q in (statistics.rating_agreement, statistics.two_rater_kappas, evaluation.calibration_bins, evaluation.calibration_model, evaluation.calibrated_results):
        assert sorted(map(tuple, q(spark, dirty).collect())) == sorted(map(tuple, q(spark, clean).collect())), q


def test_alignment_counts_all_rows(spark, sf, tmp_path):
    from spanwright.plans import behaviour

    one = spark.read.parquet(f"{sf}/spans.parquet").limit(1)
    n = F.col("n").cast("string")
    runs = [one.crossJoin(spark.range(1500).toDF("n")).withColumns({"trace_id": F.lit(t), "id": F.concat(F.lit(t), n), "parent_id": F.lit("p"), "pos": F.col("n").cast(one.schema["pos"].dataType), "source_status": F.lit(status), "name": F.concat(F.lit("step "), n), "kind": F.lit("chain"), "attributes": F.expr("map('agent.operation', concat('step ', cast(n as string)))")}).select(*one.columns) for t, status in (("a", "ok"), ("b", "error"))]
    runs[0].unionByName(runs[1]).write.parquet(f"{tmp_path}/spans.parquet")
    spark.sql("select id, map('cluster_id', 'c') as metadata from values ('a'), ('b') as t(id)").write.parquet(f"{tmp_path}/traces.parquet")
    r = behaviour.run_alignment(spark, str(tmp_path)).first()
    assert (r["n_rows"], r["changed"]) == (1500, 1500)


def test_whole_report_and_remediation(spark):
    cols = "case_id string, trace_id string, evaluator_name string, normalized_score double, calibrated_score double, passed boolean, cluster_id string"
    r = spark.createDataFrame([("a", "t", "e", 1.0, 0.5, True, "c1"), ("b", "t", "e", 0.0, None, False, "c1"), ("b", "t", "f", 1.0, None, True, None)], cols)
    c = spark.createDataFrame([("c1", "first", 2.0)], "id string, label string, weight double")
    got = {(x["section"], x["key"]): x for x in E.report(r, c).collect()}
    assert got["run", "all"]["result_count"] == 3 and got["worst_cluster", "c1"]["rank"] == 1 and got["cluster", "c1"]["text"] == "first"
    assert got["failed_case", "b"]["text"] == "c1|e" and got["counts", "unclustered_count"]["result_count"] == 1 and ("calibration", "delta") in got
    assert E.report(r.limit(0)).filter("section not in ('counts', 'run')").count() == 0
    gate = spark.createDataFrame([(True, True, False)], "baseline_reproduced boolean, candidate_resolved boolean, no_severe_novel_findings boolean")
    one = lambda n: spark.createDataFrame([(n, 5)], "tool_calls bigint, duration_ms bigint")
    budget = V.budget_gate_rows(one(3), one(4), {"tool_calls": 0}, ["tool_calls", "duration_ms"])
    assert {x["measure"]: (x["increase"], x["passed"]) for x in budget.collect()} == {"tool_calls": (1, False), "duration_ms": (0, True)}
    rows = {x["gate"]: x["passed"] for x in V.remediation(gate, budget=budget).collect()}
    assert rows == {"findings_resolved": True, "no_severe_novel_findings": False, "budget_held": False, "remediation": False}
