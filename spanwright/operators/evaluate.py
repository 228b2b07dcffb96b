"""Grading of cases, weighted scores, calibration against human ratings, and reports.

Defined results: scores are clamped to 0..1; nulls of a score that a sum needs count as no result; empty tables give a score of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.functions.text import clamp01, normalized_score, trim_u


def graded(cases: DataFrame, evaluator: str, passed: Column) -> DataFrame:
    """Results (case_id, trace_id, evaluator_name, raw_score, normalized_score, score_scale, passed) of a rule that passes or not."""
    score = F.when(passed, 1.0).otherwise(0.0)
    return cases.select(F.col("id").alias("case_id"), "trace_id", F.lit(evaluator).alias("evaluator_name"), score.alias("raw_score"), score.alias("normalized_score"), F.lit("binary").alias("score_scale"), F.coalesce(passed, F.lit(False)).alias("passed"))


def non_empty_output(cases: DataFrame) -> DataFrame:
    return graded(cases, "non_empty_output", trim_u(F.coalesce("actual_output", F.lit(""))) != "")


def exact_match(cases: DataFrame) -> DataFrame:
    """Equal but for white space at the ends; without an expected or actual output it doesn't pass."""
    return graded(cases, "exact_match", F.coalesce(trim_u(F.col("actual_output")) == trim_u(F.col("expected_output")), F.lit(False)))


def contains(cases: DataFrame, needle: str) -> DataFrame:
    return graded(cases, "contains", F.coalesce(F.col("actual_output").contains(needle), F.lit(False)))


def judged(cases: DataFrame, score: Column, evaluator: str = "prompt_judge", threshold: int = 3) -> DataFrame:
    """Results on the four-point scale from a column of scores 1..4 that a judge gave."""
    ok = score.between(1, 4)
    return cases.filter(ok).select(
        F.col("id").alias("case_id"), "trace_id", F.lit(evaluator).alias("evaluator_name"), score.cast("double").alias("raw_score"), normalized_score(score.cast("double"), F.lit("four_point")).alias("normalized_score"), F.lit("four_point").alias("score_scale"), (score >= threshold).alias("passed")
    )


def run_of(*results: DataFrame) -> DataFrame:
    """One run of several evaluators' results."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def _weighted(results: DataFrame, evaluator_weights: dict[str, float] | None, cluster_weights: DataFrame | None, default: float) -> DataFrame:
    """Adds ``_w`` (evaluator weight times cluster weight, not below 0) and ``_s`` (calibrated, else normalised score)."""
    w = F.lit(float(default))
    for name, x in (evaluator_weights or {}).items():
        w = F.when(F.col("evaluator_name") == name, float(x)).otherwise(w)
    r = results
    if "calibrated_score" not in r.columns:
        r = r.withColumn("calibrated_score", F.lit(None).cast("double"))
    if "cluster_id" not in r.columns:
        r = r.withColumn("cluster_id", F.lit(None).cast("string"))
    if cluster_weights is not None:
        c = cluster_weights.groupBy(F.col("id").alias("cluster_id")).agg(F.max("weight").alias("_cw"))
        r = r.join(c, "cluster_id", "left").withColumn("_w", F.greatest(w, F.lit(0.0)) * F.greatest(F.coalesce("_cw", F.lit(1.0)), F.lit(0.0))).drop("_cw")
    else:
        r = r.withColumn("_w", F.greatest(w, F.lit(0.0)))
    return r.withColumn("_s", F.coalesce("calibrated_score", "normalized_score"))


def _measures(score: str = "_s") -> list[Column]:
    total = F.sum(F.when(F.col(score).isNotNull(), F.col("_w")))
    return [
        F.count(F.lit(1)).alias("result_count"),
        F.count_if("passed").alias("passed_count"),
        F.coalesce(F.count_if("passed") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(F.sum(F.col("_w") * F.col(score)) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("weighted_score"),
        F.coalesce(total, F.lit(0.0)).alias("total_weight"),
    ]


def score(results: DataFrame, evaluator_weights: dict[str, float] | None = None, cluster_weights: DataFrame | None = None, default: float = 1.0) -> DataFrame:
    """One row: counts, pass rate, weighted score and its weight."""
    return _weighted(results, evaluator_weights, cluster_weights, default).agg(*_measures())


def report_scores(results: DataFrame, evaluator_weights: dict[str, float] | None = None, cluster_weights: DataFrame | None = None, default: float = 1.0) -> DataFrame:
    """Scores of the whole run, of each evaluator and of each cluster, in one pass: (``level``, ``evaluator_name``, ``cluster_id``, measures)."""
    r = _weighted(results, evaluator_weights, cluster_weights, default).withColumn("cluster_id", F.coalesce("cluster_id", F.lit("unclustered")))
    e, c = F.col("evaluator_name"), F.col("cluster_id")
    g = r.groupingSets([[], [e], [c]], e, c).agg(F.grouping_id().alias("_g"), *_measures())
    level = F.when(F.col("_g") == 3, "run").when(F.col("_g") == 1, "evaluator").otherwise("cluster")
    return g.select(level.alias("level"), "evaluator_name", "cluster_id", "result_count", "passed_count", "pass_rate", "weighted_score", "total_weight")


def cluster_scores(results: DataFrame, clusters: DataFrame | None = None, **weights: object) -> DataFrame:
    """Scores by cluster with the clusters' labels and descriptions."""
    cw = clusters if clusters is not None and "weight" in clusters.columns else None
    s = report_scores(results, cluster_weights=cw, **weights).filter("level = 'cluster'").drop("level", "evaluator_name")
    return s if clusters is None else s.join(clusters.select(F.col("id").alias("cluster_id"), "label", "description"), "cluster_id", "left")


def worst_clusters(results: DataFrame, clusters: DataFrame | None = None, **weights: object) -> DataFrame:
    """Clusters with a failed result, worst score first: ``rank`` from 1 by weighted score, then id."""
    s = cluster_scores(results, clusters, **weights).withColumn("failed_count", F.col("result_count") - F.col("passed_count")).filter("failed_count > 0")
    return s.withColumn("rank", F.row_number().over(W.orderBy("weighted_score", "cluster_id")))


def failed_cases(results: DataFrame, n: int | None = None) -> DataFrame:
    """Failed results by cluster (null first), evaluator, score and case; the first ``n`` if asked for."""
    r = _weighted(results, None, None, 1.0).filter(~F.coalesce("passed", F.lit(False)))
    out = r.select("case_id", "trace_id", "evaluator_name", "cluster_id", F.col("_s").alias("score")).orderBy(F.asc_nulls_first("cluster_id"), "evaluator_name", F.asc_nulls_first("score"), "case_id")
    return out if n is None else out.limit(n)


def calibration_impact(results: DataFrame, **weights: object) -> DataFrame:
    """One row (``raw_weighted_score``, ``calibrated_weighted_score``, ``delta``) if any result is calibrated, else none."""
    r = _weighted(results, weights.get("evaluator_weights"), weights.get("cluster_weights"), weights.get("default", 1.0))
    total = F.nullif(F.sum("_w"), F.lit(0.0))
    g = r.agg(F.coalesce(F.sum(F.col("_w") * F.col("normalized_score")) / total, F.lit(0.0)).alias("raw_weighted_score"), F.coalesce(F.sum(F.col("_w") * F.col("_s")) / total, F.lit(0.0)).alias("calibrated_weighted_score"), F.count("calibrated_score").alias("_n"))
    return g.filter("_n > 0").select("raw_weighted_score", "calibrated_weighted_score", (F.col("calibrated_weighted_score") - F.col("raw_weighted_score")).alias("delta"))


def report_counts(results: DataFrame) -> DataFrame:
    """One row: distinct cases, results, results without cluster, novel results."""
    m = F.try_element_at(F.col("metadata"), F.lit("novelty")) if "metadata" in results.columns else F.lit(None).cast("string")
    return results.agg(F.count_distinct("case_id").alias("total_cases"), F.count(F.lit(1)).alias("total_results"), F.count_if(F.col("cluster_id").isNull() | (F.col("cluster_id") == "unclustered")).alias("unclustered_count"), F.count_if(m == "true").alias("novelty_count"))


def report(results: DataFrame, clusters: DataFrame | None = None, worst: int = 5, failed: int = 20, **weights: object) -> DataFrame:
    """The whole report as one long table (``section``, ``key``, ``rank``, ``result_count``, ``passed_count``, ``pass_rate``, ``weighted_score``, ``text``).

    Sections: ``counts`` (cases, results, unclustered, novelty), ``run``, ``evaluator``, ``cluster``, ``worst_cluster`` (the ``worst`` worst), ``failed_case`` (the first ``failed``), ``calibration``
    (raw, calibrated, delta; only if results are calibrated).
    """
    null = lambda t: F.lit(None).cast(t)
    shape = lambda section, key, rank=None, n=None, ok=None, rate=None, score=None, text=None: [
        F.lit(section).alias("section"), key.cast("string").alias("key"), (null("bigint") if rank is None else rank.cast("bigint")).alias("rank"), (null("bigint") if n is None else n.cast("bigint")).alias("result_count"), (null("bigint") if ok is None else ok.cast("bigint")).alias("passed_count"),
        (null("double") if rate is None else rate).alias("pass_rate"), (null("double") if score is None else score).alias("weighted_score"), (null("string") if text is None else text).alias("text"),
    ]
    measures = [F.col("result_count"), F.col("passed_count"), F.col("pass_rate"), F.col("weighted_score")]
    cw = clusters if clusters is not None and "weight" in clusters.columns else None
    scores = report_scores(results, cluster_weights=cw, **weights)
    label = lambda df: df if clusters is None else df.join(clusters.groupBy(F.col("id").alias("cluster_id")).agg(F.min("label").alias("_label")), "cluster_id", "left")
    text = null("string") if clusters is None else F.col("_label")
    counts = report_counts(results)
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("bigint").alias("n")) for c in counts.columns])).alias("x"))
    out = long.select(*shape("counts", F.col("x.k"), n=F.col("x.n")))
    out = out.unionByName(scores.filter("level = 'run'").select(*shape("run", F.lit("all"), None, *measures)))
    out = out.unionByName(scores.filter("level = 'evaluator'").select(*shape("evaluator", F.col("evaluator_name"), None, *measures)))
    by_cluster = label(scores.filter("level = 'cluster'"))
    out = out.unionByName(by_cluster.select(*shape("cluster", F.col("cluster_id"), None, *measures, text)))
    bad = by_cluster.filter("result_count > passed_count").orderBy("weighted_score", "cluster_id").limit(worst)
    ranked = bad.withColumn("rank", F.row_number().over(W.orderBy("weighted_score", "cluster_id")))  # at most ``worst`` rows
    out = out.unionByName(ranked.select(*shape("worst_cluster", F.col("cluster_id"), F.col("rank"), *measures, text)))
    f = failed_cases(results, failed)
    f = f.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_first("cluster_id"), "evaluator_name", F.asc_nulls_first("score"), "case_id")))  # at most ``failed`` rows
    out = out.unionByName(f.select(*shape("failed_case", F.col("case_id"), F.col("rank"), score=F.col("score"), text=F.concat_ws("|", F.coalesce("cluster_id", F.lit("")), "evaluator_name"))))
    c = calibration_impact(results, cluster_weights=cw, **weights)
    c = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in ("raw_weighted_score", "calibrated_weighted_score", "delta")])).alias("x"))
    return out.unionByName(c.select(*shape("calibration", F.col("x.k"), score=F.col("x.v"))))


def fit_calibration(results: DataFrame, ratings: DataFrame, threshold: int = 3) -> tuple[DataFrame, DataFrame]:
    """(bins, model) from results and ratings (case_id, score 1..4; of several of a case the greatest ``ord`` counts, if there).

    bins: ``bin_key`` (score in thousandths), ``score`` (the one seen first, by the results' ``ord`` if there, else the least), ``n``, ``mean_human``, ``pass_rate``. model, one row: ``n``, ``global_pass_rate``,
    ``mean_absolute_error``, ``evaluator_name`` (if all results have one).
    """
    if not 1 <= threshold <= 4:
        raise ValueError("the threshold is on the scale 1..4")
    by = F.col("ord") if "ord" in ratings.columns else F.lit(0)
    told = F.col("passed") if "passed" in ratings.columns else F.lit(None).cast("boolean")
    last = ratings.filter("case_id is not null").groupBy("case_id").agg(F.max_by(F.struct("score", told.alias("passed")), F.struct(by, "score")).alias("_r"))
    last = last.select("case_id", F.col("_r.score").alias("_h"), F.col("_r.passed").alias("_told"))
    checked = F.when(F.col("_h").between(1, 4), F.col("_h")).otherwise(F.raise_error(F.lit("a human score is from 1 to 4")).cast("int"))
    x = results.filter("normalized_score is not null").join(last, "case_id").withColumns({"_h": checked, "_x": clamp01(F.col("normalized_score"))})
    x = x.withColumns({"_hn": (F.col("_h") - 1) / 3.0, "_p": F.coalesce("_told", F.col("_h") >= threshold).cast("double"), "bin_key": F.round(F.col("_x") * 1000).cast("int")})
    seen = F.col("ord") if "ord" in results.columns else F.lit(0)
    bins = x.groupBy("bin_key").agg(F.min_by("_x", F.struct(seen, "_x")).alias("score"), F.count(F.lit(1)).alias("n"), F.avg("_hn").alias("mean_human"), F.avg("_p").alias("pass_rate"))
    model = x.agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("global_pass_rate"), F.avg(F.abs(F.col("_x") - F.col("_hn"))).alias("mean_absolute_error"), F.when(F.count_distinct("evaluator_name") == 1, F.min("evaluator_name")).alias("evaluator_name"))
    return bins, model


def calibrated(results: DataFrame, bins: DataFrame, evaluator: str | None = None) -> DataFrame:
    """Results with ``calibrated_score``: the pass rate of the nearest bin (of two the lower). Results of other evaluators keep theirs.

    Bins are at most 1001 rows; a sorted array of them is searched.
    """
    b = bins.agg(F.array_sort(F.collect_list(F.struct("score", "pass_rate"))).alias("_b"))
    r = results.drop("calibrated_score") if "calibrated_score" in results.columns and evaluator is None else results
    old = F.col("calibrated_score") if "calibrated_score" in r.columns else F.lit(None).cast("double")
    r = r.join(F.broadcast(b))
    near = F.array_min(F.transform("_b", lambda y: F.struct(F.abs(y["score"] - clamp01(F.col("normalized_score"))).alias("d"), y["score"].alias("s"), y["pass_rate"].alias("p"))))
    new = F.when(F.size("_b") > 0, near["p"])
    mine = F.lit(True) if evaluator is None else F.col("evaluator_name") == evaluator
    return r.withColumn("calibrated_score", F.when(mine, new).otherwise(old)).drop("_b")
