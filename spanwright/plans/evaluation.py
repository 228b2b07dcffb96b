"""Queries on cases, results and ratings: extraction, grading, scores, calibration, validation, clusters by rule, pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.text import on_scale
from spanwright.operators import cluster as C
from spanwright.operators import evaluate as E
from spanwright.operators import extract as X
from spanwright.operators import verify as V
from spanwright.session import table
from spanwright.sources import files as S

CLUSTERS = [
    ("visits", "visit", ["slot", "planner"]),
    ("tariffs", "tariff", ["crates", "fee"]),
    ("failures", "failure", ["step", "failed"]),
    ("parcels", "parcel", ["pickup", "depot"]),
    ("checks", "checks", ["scope", "policy", "tone"]),
    ("tickets", "ticket", ["locker", "delivery"]),
]
WEIGHTS = {"visits": 1.5, "tariffs": 0.5}
SPLIT = "2025-03-15 00:00:00"


def clusters(spark: SparkSession) -> DataFrame:
    rows = [(i, n, label, WEIGHTS.get(n, 1.0), (None, words), f"cases about {label}") for i, (n, label, words) in enumerate(CLUSTERS)]
    return spark.createDataFrame(rows, "ord bigint, id string, label string, weight double, metadata struct<tag:string,keywords:array<string>>, description string")


def _round(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases")


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_results")


def extract_simple_cases(spark: SparkSession, d: str) -> DataFrame:
    return X.simple_cases(table(spark, d, "spans")).drop("metadata")


def extract_openinference_cases(spark: SparkSession, d: str) -> DataFrame:
    c = X.openinference_cases(table(spark, d, "spans"), table(spark, d, "traces"))
    return c.select("id", "trace_id", "input", "actual_output", F.try_element_at("metadata", F.lit("source_span_id")).alias("source_span_id"), F.try_element_at("metadata", F.lit("output_span_id")).alias("output_span_id"))


def cluster_texts(spark: SparkSession, d: str) -> DataFrame:
    return X.cluster_text(_cases(spark, d)).distinct()


def grade_non_empty(spark: SparkSession, d: str) -> DataFrame:
    return E.non_empty_output(_cases(spark, d)).select("case_id", "passed", "normalized_score")


def grade_exact(spark: SparkSession, d: str) -> DataFrame:
    return E.exact_match(_cases(spark, d)).select("case_id", "passed", "normalized_score")


def grade_contains(spark: SparkSession, d: str) -> DataFrame:
    return E.contains(_cases(spark, d), "slot").select("case_id", "passed", "normalized_score")


def score_overall(spark: SparkSession, d: str) -> DataFrame:
    return _round(E.score(_results(spark, d), {"prompt_judge": 2.0}, clusters(spark)))


def report_scores(spark: SparkSession, d: str) -> DataFrame:
    return _round(E.report_scores(_results(spark, d), {"prompt_judge": 2.0}, clusters(spark)))


def worst_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _round(E.worst_clusters(_results(spark, d), clusters(spark)).select("rank", "cluster_id", "failed_count", "weighted_score", "label"))


def failed_cases(spark: SparkSession, d: str) -> DataFrame:
    return E.failed_cases(_results(spark, d))


def whole_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts, scores, worst clusters, failed cases and calibration impact as one table."""
    return _round(E.report(_results(spark, d)))


def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.report_counts(_results(spark, d))


def calibration_impact(spark: SparkSession, d: str) -> DataFrame:
    return _round(E.calibration_impact(_results(spark, d)))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Human scores 1..4 from the labels of the agreement table, whatever their letter case, blanks and hyphens."""
    r = table(spark, d, "agreement_ratings")
    label = on_scale(F.col("label"), ["resolved", "partly_resolved", "unresolved", "harmful"])
    s = F.when(label == "resolved", 4).when(label == "partly_resolved", 3).when(label == "unresolved", 2).when(label == "harmful", 1)
    return r.select(F.col("item_id").alias("case_id"), s.alias("score"), F.col("rated_at").alias("ord")).filter("score is not null")


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return _round(E.fit_calibration(_results(spark, d).filter("evaluator_name = 'prompt_judge'"), ratings(spark, d))[0])


def calibration_model(spark: SparkSession, d: str) -> DataFrame:
    return _round(E.fit_calibration(_results(spark, d).filter("evaluator_name = 'prompt_judge'"), ratings(spark, d))[1])


def calibrated_results(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    bins, _ = E.fit_calibration(r.filter("evaluator_name = 'prompt_judge'"), ratings(spark, d))
    return _round(E.calibrated(r, bins).select("case_id", "evaluator_name", "normalized_score", "calibrated_score"))


def validate_cases(spark: SparkSession, d: str) -> DataFrame:
    return V.report(V.validate_cases(_cases(spark, d)))


def validate_results(spark: SparkSession, d: str) -> DataFrame:
    return V.report(V.validate_results(_results(spark, d), _cases(spark, d)))


def metadata_assign(spark: SparkSession, d: str) -> DataFrame:
    return C.metadata_rule(_cases(spark, d), clusters(spark))


def keyword_assign(spark: SparkSession, d: str) -> DataFrame:
    return _round(C.keyword_rule(_cases(spark, d), clusters(spark)).distinct())


def rule_assign(spark: SparkSession, d: str) -> DataFrame:
    return _round(C.assign_by_rules(_cases(spark, d).dropDuplicates(["id"]), clusters(spark)).drop("trace_id"))


def assigned_results(spark: SparkSession, d: str) -> DataFrame:
    a = C.metadata_rule(_cases(spark, d), clusters(spark))
    return C.with_assignments(_results(spark, d), a).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _results(spark, d).withColumn("evaluator_version", F.when(F.col("evaluator_name") != "exact_match", F.lit("1"))).withColumn("ord", F.col("evaluated_at"))
    return r.filter(F.col("evaluated_at") < F.lit(SPLIT).cast("timestamp")), r.filter(F.col("evaluated_at") >= F.lit(SPLIT).cast("timestamp"))


def paired_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of a case and evaluator before and since a date."""
    return V.paired_results(*_halves(spark, d)).select("case_id", "evaluator_name", "evaluator_version", "pairing", "baseline_rows", "candidate_rows")


def case_gates(spark: SparkSession, d: str) -> DataFrame:
    return V.case_gates(V.paired_results(*_halves(spark, d)))


def suite_gate(spark: SparkSession, d: str) -> DataFrame:
    b, c = _halves(spark, d)
    return V.suite_gate(V.paired_results(b, c), b.select("case_id").distinct())


def export_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.cases_csv(_cases(spark, d)).distinct()


def export_openai_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.openai_eval_rows(_cases(spark, d)).select("input", "ideal", "metadata.case_id", "metadata.trace_id").distinct()


def export_promptfoo_tests(spark: SparkSession, d: str) -> DataFrame:
    return S.promptfoo_tests(_cases(spark, d)).distinct()


QUERIES = {f.__name__: f for f in (
    extract_simple_cases, extract_openinference_cases, cluster_texts, grade_non_empty, grade_exact, grade_contains, score_overall, report_scores, worst_clusters, failed_cases, whole_report, report_counts, calibration_impact, calibration_bins,
    calibration_model, calibrated_results, validate_cases, validate_results, metadata_assign, keyword_assign, rule_assign, assigned_results, paired_results, case_gates, suite_gate, export_csv_rows, export_openai_rows, export_promptfoo_tests,
)}

ONCE = """once AS (
  SELECT trace_id, id, any_value(pos) AS pos, any_value(parent_id) AS parent_id, any_value(name) AS name, any_value(kind) AS kind, any_value(input) AS input, any_value(output) AS output, any_value(error) AS error,
    arg_min(started_at, ingested_at) AS started_at, arg_min(ended_at, ingested_at) AS ended_at, any_value(source_status) AS source_status, any_value(attributes) AS attributes
  FROM spans WHERE trace_id IS NOT NULL AND id IS NOT NULL GROUP BY trace_id, id
), kinds AS (
  SELECT *, CASE WHEN kind = 'other' AND lower(trim(attributes['openinference.span.kind'])) IN ('llm','agent','tool','chain','retriever','retrieval','reranker','embedding','guardrail','evaluator','prompt')
    THEN replace(lower(trim(attributes['openinference.span.kind'])), 'retrieval', 'retriever') ELSE coalesce(kind, 'other') END AS k FROM once
)"""
_TRIM = r"regexp_replace({0}, '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')"
_K = "clusters(ord, id, label, weight, words) AS (VALUES " + ", ".join(f"({i}, '{n}', '{label}', {WEIGHTS.get(n, 1.0)}::DOUBLE, {[label, *[w for w in words if w != label]]})" for i, (n, label, words) in enumerate(CLUSTERS)) + ")"
_W = f"WITH {_K}, r AS (SELECT e.*, coalesce(calibrated_score, normalized_score) AS s, (CASE WHEN evaluator_name = 'prompt_judge' THEN 2.0 ELSE 1.0 END)::DOUBLE * coalesce(c.weight, 1.0) AS w, coalesce(c.weight, 1.0)::DOUBLE AS cw, coalesce(cluster_id, 'unclustered') AS cl, c.label FROM eval_results e LEFT JOIN clusters c ON c.id = e.cluster_id)"
_M = "count(*) AS result_count, count(*) FILTER (passed) AS passed_count, round(coalesce(count(*) FILTER (passed) / nullif(count(*), 0), 0), 6) AS pass_rate, round(coalesce(sum(w * s) / nullif(sum(w) FILTER (s IS NOT NULL), 0), 0), 6) AS weighted_score, round(coalesce(sum(w) FILTER (s IS NOT NULL), 0), 6) AS total_weight"
_CAL = """WITH h AS (SELECT item_id, arg_max(score, (rated_at, score)) AS h FROM (SELECT *, CASE regexp_replace(lower(regexp_replace(label, '^\\s+|\\s+$', '', 'g')), '[ -]', '_', 'g') WHEN 'resolved' THEN 4 WHEN 'partly_resolved' THEN 3 WHEN 'unresolved' THEN 2 WHEN 'harmful' THEN 1 END AS score FROM agreement_ratings) WHERE score IS NOT NULL AND item_id IS NOT NULL GROUP BY item_id),
x AS (SELECT least(greatest(normalized_score, 0), 1) AS x, (h - 1) / 3.0::DOUBLE AS hn, CASE WHEN h >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, CAST(round(least(greatest(normalized_score, 0), 1) * 1000) AS INT) AS bin_key, evaluator_name FROM eval_results JOIN h ON h.item_id = case_id WHERE evaluator_name = 'prompt_judge' AND normalized_score IS NOT NULL),
bins AS (SELECT bin_key, min(x) AS score, count(*) AS n, avg(hn) AS mean_human, avg(p) AS pass_rate FROM x GROUP BY bin_key)"""
_HALVES = f"""WITH r AS (SELECT *, CASE WHEN evaluator_name <> 'exact_match' THEN '1' END AS v FROM eval_results),
b AS (SELECT case_id, evaluator_name, v, arg_min(struct_pack(s := normalized_score, p := passed), (evaluated_at, struct_pack(s := normalized_score, p := passed))) AS x, count(*) AS n, bool_and(coalesce(normalized_score BETWEEN 0 AND 1, false)) AS ok FROM r WHERE evaluated_at < TIMESTAMP '{SPLIT}' GROUP BY ALL),
c AS (SELECT case_id, evaluator_name, v, arg_min(struct_pack(s := normalized_score, p := passed), (evaluated_at, struct_pack(s := normalized_score, p := passed))) AS x, count(*) AS n, bool_and(coalesce(normalized_score BETWEEN 0 AND 1, false)) AS ok FROM r WHERE evaluated_at >= TIMESTAMP '{SPLIT}' GROUP BY ALL),
j AS (SELECT coalesce(b.case_id, c.case_id) AS case_id, coalesce(b.evaluator_name, c.evaluator_name) AS evaluator_name, coalesce(b.v, c.v) AS evaluator_version,
  CASE WHEN c.n IS NULL THEN 'missing_candidate' WHEN b.n IS NULL THEN 'unexpected_candidate' ELSE 'paired' END AS pairing, coalesce(b.n, 0) AS baseline_rows, coalesce(c.n, 0) AS candidate_rows,
  c.x.p AS cp, b.x.p AS bp, c.x.s - b.x.s AS delta, coalesce(b.ok, true) AND coalesce(c.ok, true) AS valid
  FROM b FULL JOIN c ON b.case_id = c.case_id AND b.evaluator_name = c.evaluator_name AND b.v IS NOT DISTINCT FROM c.v)"""
_FAILS = """count(*) FILTER (pairing = 'missing_candidate') AS missing_candidate_results, count(*) FILTER (pairing = 'unexpected_candidate') AS unexpected_candidate_results, {0}
count(*) FILTER (evaluator_version IS NULL) AS unversioned_results, count(*) FILTER (case_id IS NULL OR trim(case_id) = '' OR evaluator_name IS NULL OR trim(evaluator_name) = '') AS invalid_identity_results,
count(*) FILTER (NOT valid) AS invalid_score_results, count(*) FILTER (baseline_rows > 1) AS duplicate_baseline_results, count(*) FILTER (candidate_rows > 1) AS duplicate_candidate_results"""

SQL = {
    "extract_simple_cases": f"""WITH {ONCE}, g AS (SELECT trace_id, coalesce(arg_min(id, CASE WHEN kind = 'llm' AND input IS NOT NULL THEN pos END), arg_min(id, CASE WHEN input IS NOT NULL THEN pos END)) AS i,
      coalesce(arg_max(id, CASE WHEN kind = 'llm' AND output IS NOT NULL THEN pos END), arg_max(id, CASE WHEN output IS NOT NULL THEN pos END)) AS o FROM once GROUP BY trace_id)
      SELECT g.trace_id || ':' || i AS id, g.trace_id, a.input, b.output AS actual_output FROM g JOIN once a ON a.trace_id = g.trace_id AND a.id = i LEFT JOIN once b ON b.trace_id = g.trace_id AND b.id = o""",
    "extract_openinference_cases": f"""WITH {ONCE}, t AS (SELECT *, coalesce(input, attributes['input.value']) AS ti, coalesce(output, attributes['output.value']) AS tx, parent_id IS NULL AND k IN ('agent', 'chain') AS root FROM kinds),
      g AS (SELECT trace_id, coalesce(arg_min(id, CASE WHEN root AND ti IS NOT NULL THEN pos END), arg_min(id, CASE WHEN k = 'llm' AND ti IS NOT NULL THEN pos END), arg_min(id, CASE WHEN ti IS NOT NULL THEN pos END)) AS i,
      coalesce(arg_max(id, CASE WHEN root AND tx IS NOT NULL THEN pos END), arg_max(id, CASE WHEN k = 'llm' AND tx IS NOT NULL THEN pos END), arg_max(id, CASE WHEN tx IS NOT NULL THEN pos END)) AS o FROM t GROUP BY trace_id)
      SELECT g.trace_id || ':' || i AS id, g.trace_id, a.ti AS input, b.tx AS actual_output, i AS source_span_id, o AS output_span_id FROM g JOIN t a ON a.trace_id = g.trace_id AND a.id = i LEFT JOIN t b ON b.trace_id = g.trace_id AND b.id = o""",
    "grade_non_empty": f"SELECT id AS case_id, {_TRIM.format(chr(39) * 0 + 'coalesce(actual_output, ' + chr(39) * 2 + ')')} <> '' AS passed, CASE WHEN {_TRIM.format('coalesce(actual_output, ' + chr(39) * 2 + ')')} <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS normalized_score FROM cases",
    "grade_exact": f"SELECT id AS case_id, coalesce({_TRIM.format('actual_output')} = {_TRIM.format('expected_output')}, false) AS passed, CASE WHEN {_TRIM.format('actual_output')} = {_TRIM.format('expected_output')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS normalized_score FROM cases",
    "grade_contains": "SELECT id AS case_id, coalesce(contains(actual_output, 'slot'), false) AS passed, CASE WHEN contains(actual_output, 'slot') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS normalized_score FROM cases",
    "score_overall": f"{_W} SELECT {_M} FROM r",
    "report_scores": f"{_W} SELECT CASE grouping_id(evaluator_name, cl) WHEN 3 THEN 'run' WHEN 1 THEN 'evaluator' ELSE 'cluster' END AS level, evaluator_name, cl AS cluster_id, {_M} FROM r GROUP BY GROUPING SETS ((), (evaluator_name), (cl))",
    "worst_clusters": f"""{_W}, g AS (SELECT cl AS cluster_id, count(*) - count(*) FILTER (passed) AS failed_count, coalesce(sum(cw * s) / nullif(sum(cw) FILTER (s IS NOT NULL), 0), 0) AS ws, any_value(label) AS label FROM r GROUP BY cl)
      SELECT row_number() OVER (ORDER BY ws, cluster_id) AS rank, cluster_id, failed_count, round(ws, 6) AS weighted_score, label FROM g WHERE failed_count > 0""",
    "failed_cases": "SELECT case_id, trace_id, evaluator_name, cluster_id, coalesce(calibrated_score, normalized_score) AS score FROM eval_results WHERE NOT coalesce(passed, false)",
    "report_counts": "SELECT count(DISTINCT case_id) AS total_cases, count(*) AS total_results, count(*) FILTER (cluster_id IS NULL OR cluster_id = 'unclustered') AS unclustered_count, CAST(0 AS BIGINT) AS novelty_count FROM eval_results",
    "calibration_impact": "WITH g AS (SELECT sum(normalized_score) / count(*) AS a, sum(coalesce(calibrated_score, normalized_score)) / count(*) AS b FROM eval_results HAVING count(calibrated_score) > 0) SELECT round(a, 6) AS raw_weighted_score, round(b, 6) AS calibrated_weighted_score, round(b - a, 6) AS delta FROM g",
    "calibration_bins": f"{_CAL} SELECT bin_key, round(score, 6) AS score, n, round(mean_human, 6) AS mean_human, round(pass_rate, 6) AS pass_rate FROM bins",
    "calibration_model": f"{_CAL} SELECT count(*) AS n, round(avg(p), 6) AS global_pass_rate, round(avg(abs(x - hn)), 6) AS mean_absolute_error, CASE WHEN count(DISTINCT evaluator_name) = 1 THEN min(evaluator_name) END AS evaluator_name FROM x",
    "calibrated_results": f"{_CAL} SELECT case_id, evaluator_name, round(normalized_score, 6) AS normalized_score, round(CASE WHEN normalized_score IS NULL THEN (SELECT arg_min(pass_rate, score) FROM bins) ELSE (SELECT arg_min(pass_rate, (abs(score - least(greatest(e.normalized_score, 0), 1)), score)) FROM bins) END, 6) AS calibrated_score FROM eval_results e",
    "validate_cases": f"""WITH i AS (SELECT 'missing_case_id' AS code FROM cases WHERE coalesce({_TRIM.format('id')}, '') = '' UNION ALL SELECT 'duplicate_case_id' FROM (SELECT id, count(*) AS n FROM cases WHERE coalesce({_TRIM.format('id')}, '') <> '' GROUP BY id), range(2, n + 1)
      UNION ALL SELECT 'missing_trace_id' FROM cases WHERE coalesce({_TRIM.format('trace_id')}, '') = '' UNION ALL SELECT 'missing_input' FROM cases WHERE coalesce({_TRIM.format('input')}, '') = '' UNION ALL SELECT 'missing_actual_output' FROM cases WHERE coalesce({_TRIM.format('actual_output')}, '') = '')
      SELECT 'error' AS severity, code, count(*) AS n FROM i GROUP BY code""".replace("FROM (SELECT id, count(*) AS n FROM cases", "FROM (SELECT unnest(range(2, n + 1)) FROM (SELECT id, count(*) AS n FROM cases").replace(" GROUP BY id), range(2, n + 1)", " GROUP BY id))"),
    "validate_results": f"""WITH i AS (SELECT 'missing_case_id' AS code FROM eval_results WHERE coalesce({_TRIM.format('case_id')}, '') = '' UNION ALL SELECT 'missing_trace_id' FROM eval_results WHERE coalesce({_TRIM.format('trace_id')}, '') = ''
      UNION ALL SELECT 'missing_evaluator_name' FROM eval_results WHERE coalesce({_TRIM.format('evaluator_name')}, '') = '' UNION ALL SELECT 'duplicate_result' FROM (SELECT unnest(range(2, n + 1)) FROM (SELECT count(*) AS n FROM eval_results GROUP BY case_id, evaluator_name))
      UNION ALL SELECT 'invalid_raw_score' FROM eval_results WHERE NOT coalesce(CASE WHEN score_scale = 'four_point' THEN raw_score BETWEEN 1 AND 4 WHEN score_scale IN ('binary', 'unit') THEN raw_score BETWEEN 0 AND 1 ELSE false END, false)
      UNION ALL SELECT 'invalid_normalized_score' FROM eval_results WHERE NOT coalesce(normalized_score BETWEEN 0 AND 1, false) UNION ALL SELECT 'invalid_calibrated_score' FROM eval_results WHERE calibrated_score IS NOT NULL AND NOT calibrated_score BETWEEN 0 AND 1
      UNION ALL SELECT 'unknown_result_case' FROM eval_results WHERE NOT EXISTS (SELECT 1 FROM cases WHERE cases.id = case_id)) SELECT 'error' AS severity, code, count(*) AS n FROM i GROUP BY code""",
    "metadata_assign": f"""WITH {_K}, c AS (SELECT id, unnest([{{'k': 0, 'v': metadata['cluster_id']}}, {{'k': 1, 'v': metadata['cluster']}}, {{'k': 2, 'v': metadata['task_cluster']}}]) AS x FROM cases)
      SELECT c.id AS case_id, arg_min(k.id, (x.k, k.ord)) AS cluster_id, 1.0::DOUBLE AS confidence FROM c JOIN clusters k ON trim(x.v) IN (k.id, k.label) WHERE c.id IS NOT NULL GROUP BY c.id UNION ALL SELECT NULL, NULL, NULL WHERE false""",
    "keyword_assign": f"""WITH {_K}, t AS (SELECT DISTINCT id, lower(concat_ws(chr(10), input, actual_output, expected_output, rubric)) AS t FROM cases), h AS (SELECT t.id, t.t, k.id AS cid, k.ord, len(list_filter(k.words, lambda w: contains(t.t, w))) AS n FROM t, clusters k)
      SELECT DISTINCT id AS case_id, arg_max(cid, (n, -ord)) AS cluster_id, round(least(0.6 + (max(n) - 1) * 0.1, 0.9)::DOUBLE, 6) AS confidence FROM h GROUP BY id, t HAVING max(n) > 0""",
    "assigned_results": f"""WITH {_K}, c AS (SELECT DISTINCT c.id, k.id AS cid FROM cases c JOIN clusters k ON trim(metadata['cluster_id']) IN (k.id, k.label)), a AS (SELECT id, min(cid) AS cid FROM c GROUP BY id)
      SELECT coalesce(a.cid, e.cluster_id) AS cluster_id, count(*) AS n FROM eval_results e LEFT JOIN a ON a.id = e.case_id GROUP BY 1""",
    "paired_results": f"{_HALVES} SELECT case_id, evaluator_name, evaluator_version, pairing, baseline_rows, candidate_rows FROM j",
    "case_gates": f"""{_HALVES}, g AS (SELECT case_id, count(*) FILTER (pairing = 'paired') AS paired_result_count, count(*) FILTER (pairing <> 'unexpected_candidate') AS nb, {_FAILS.format("count(*) FILTER (pairing = 'paired' AND NOT cp) AS failed_candidate_results,")} FROM j GROUP BY case_id)
      SELECT * EXCLUDE (nb), nb > 0 AND missing_candidate_results + unexpected_candidate_results + failed_candidate_results + unversioned_results + invalid_identity_results + invalid_score_results + duplicate_baseline_results + duplicate_candidate_results = 0 AS passed FROM g""",
    "suite_gate": f"""{_HALVES}, suite AS (SELECT DISTINCT case_id FROM eval_results WHERE evaluated_at < TIMESTAMP '{SPLIT}' AND case_id IS NOT NULL), g AS (SELECT count(*) FILTER (pairing = 'paired') AS paired_result_count, {_FAILS.format("")},
      count(*) FILTER (pairing = 'paired' AND bp AND NOT cp) AS regressed_results, coalesce(max(-delta), 0) AS largest_drop FROM j WHERE case_id IN (FROM suite))
      SELECT *, CAST(0 AS BIGINT) AS missing_baseline_cases, paired_result_count > 0 AND regressed_results = 0 AND largest_drop <= 0 AND missing_candidate_results + unexpected_candidate_results + unversioned_results + invalid_identity_results + invalid_score_results + duplicate_baseline_results + duplicate_candidate_results = 0 AS passed FROM g""",
    "rule_assign": f"""WITH {_K}, one AS (SELECT id, any_value(metadata) AS metadata, any_value(input) AS input, any_value(actual_output) AS actual_output, any_value(expected_output) AS expected_output, any_value(rubric) AS rubric FROM cases GROUP BY id),
      m AS (SELECT o.id, min(k.id) AS cid FROM one o JOIN clusters k ON trim(o.metadata['cluster_id']) IN (k.id, k.label) GROUP BY o.id),
      h AS (SELECT o.id, k.id AS cid, k.ord, len(list_filter(k.words, lambda w: contains(lower(concat_ws(chr(10), input, actual_output, expected_output, rubric)), w))) AS n FROM one o, clusters k), w AS (SELECT id, arg_max(cid, (n, -ord)) AS cid, max(n) AS n FROM h GROUP BY id HAVING max(n) > 0)
      SELECT o.id AS case_id, coalesce(m.cid, w.cid, 'unclustered') AS cluster_id, round(CASE WHEN m.cid IS NOT NULL THEN 1 WHEN w.cid IS NOT NULL THEN least(0.6 + (w.n - 1) * 0.1, 0.9) ELSE 0 END::DOUBLE, 6) AS confidence, CASE WHEN m.cid IS NOT NULL THEN 'metadata' WHEN w.cid IS NOT NULL THEN 'keyword' ELSE 'fallback' END AS method
      FROM one o LEFT JOIN m ON m.id = o.id LEFT JOIN w ON w.id = o.id WHERE o.id IS NOT NULL OR true""",
    "cluster_texts": "WITH t AS (SELECT id, coalesce(array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {_TRIM.format(c)} <> '' THEN '{n}:' || chr(10) || {_TRIM.format(c)} END" for n, c in [("input", "input"), ("rubric", "rubric"), ("expected_output", "expected_output"), *[(k, f"metadata['{k}']") for k in X.CLUSTER_FIELDS]])
    + "], lambda x: x IS NOT NULL), chr(10) || chr(10)), '') AS text FROM cases) SELECT DISTINCT id, text, sha256(text) AS text_hash FROM t",
    "export_csv_rows": "SELECT DISTINCT coalesce(id, '') AS id, coalesce(trace_id, '') AS trace_id, coalesce(input, '') AS input, coalesce(actual_output, '') AS actual_output, coalesce(expected_output, '') AS expected_output, coalesce(rubric, '') AS rubric FROM cases",
    "export_openai_rows": "SELECT DISTINCT input, coalesce(expected_output, '') AS ideal, id AS case_id, trace_id FROM cases",
}
