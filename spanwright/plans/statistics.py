"""Queries on statistics of predictions and ratings, and on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.text import on_scale
from spanwright.operators import cluster as C
from spanwright.operators import stats as T
from spanwright.session import table

SCALE = ["resolved", "partly_resolved", "unresolved", "harmful"]


def _round(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Doubt (1 - confidence) as the probability that a result is a failure; results without confidence abstain."""
    r = table(spark, d, "eval_results")
    return r.select((1 - F.col("confidence")).alias("p"), (~F.coalesce("passed", F.lit(False))).alias("label"), F.coalesce("cluster_id", F.lit("none")).alias("grp"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return T.confusion(predictions(spark, d))


def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.rates(T.confusion(predictions(spark, d))).select("precision", "precision_lower", "precision_upper", "recall", "recall_lower", "recall_upper", "specificity", "specificity_lower", "specificity_upper", "f1", "macro_f1", "mcc"))


def brier_score(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.brier(predictions(spark, d)))


def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.reliability_bins(predictions(spark, d)))


def expected_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.expected_calibration_error(predictions(spark, d)))


def precision_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.precision_recall_curve(predictions(spark, d)).select("threshold", "tp", "fp", "precision", "recall"))


def precision_recall_areas(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.precision_recall_areas(predictions(spark, d)))


def selective_risk(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.selective_risk(predictions(spark, d)))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.grouped_bootstrap(predictions(spark, d), "grp"))


def logistic_calibration(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "eval_results").withColumns({"label": ~F.coalesce("passed", F.lit(False)), "k": F.concat_ws("|", "case_id", "evaluator_name")})
    m = T.fit_logistic(r, ["confidence", "normalized_score"], "label", "k")
    return _round(m.predict(r).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p")), 4)


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """The latest rating of each rater for an item, its label in the spelling of the scale."""
    r = table(spark, d, "agreement_ratings").withColumn("label", on_scale(F.col("label"), SCALE)).dropna(subset=["label", "item_id", "rater_id"])
    return r.groupBy("item_id", "rater_id").agg(F.max_by("label", F.struct("rated_at", "label")).alias("label"))


def rating_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.agreement(_ratings(spark, d)))


def two_rater_kappas(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    top = r.groupBy("rater_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rater_id").limit(2).select("rater_id")
    return _round(T.two_rater_kappas(r.join(top, "rater_id", "left_semi"), SCALE))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return m.select(F.format_string("c%03d", "label").alias("id"), F.col("v.x").alias("centroid"))


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _round(C.nearest_centroid(_vectors(spark, d), "vec_id", "embedding", _centroids(spark, d), threshold=0.9))


def _topk(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _vectors(spark, d)
        return C.top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5, metric).select("query_id", "hit_id", "rank", F.round("distance", 5).alias("distance"))

    return run


def vector_topk_ivf(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    return C.InvertedLists(e, "vec_id", "embedding", lists=16).search(e.filter("vec_id % 100 = 0"), 5, probes=12).select("query_id", "hit_id", "rank", F.round("distance", 5).alias("distance"))


def silhouette_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return _round(C.silhouettes(_vectors(spark, d), "vec_id", "embedding", "label"), 5)


def kmeans_sizes(spark: SparkSession, d: str) -> DataFrame:
    return C.discover(_vectors(spark, d), "vec_id", "embedding", 8)[0].select("id", "size")


QUERIES = {f.__name__: f for f in (
    confusion_matrix, wilson_intervals, brier_score, reliability_bins, expected_calibration_error, precision_recall_curve, precision_recall_areas, selective_risk, bootstrap_interval, logistic_calibration, rating_agreement, two_rater_kappas, nearest_centroid, vector_topk_ivf, silhouette_by_cluster, kmeans_sizes,
)} | {"vector_topk_cosine": _topk("cosine"), "vector_topk_euclidean": _topk("euclidean"), "vector_topk_inner_product": _topk("negative_inner_product")}

_P = "WITH p AS (SELECT 1 - confidence AS p, NOT coalesce(passed, false) AS label FROM eval_results), d AS (SELECT * FROM p WHERE p IS NOT NULL)"
_C = _P + ", c AS (SELECT count(*) FILTER (p >= 0.5 AND label) AS tp, count(*) FILTER (p >= 0.5 AND NOT label) AS fp, count(*) FILTER (p < 0.5 AND NOT label) AS tn, count(*) FILTER (p < 0.5 AND label) AS fn FROM d)"


def _w(name: str, a: str, b: str) -> str:
    z, n = "1.959963984540054::DOUBLE", f"({b})::DOUBLE"
    p = f"(({a}) / {n})"
    mid = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return f"round({p}, 6) AS {name}, round(CASE WHEN {a} = 0 THEN 0 ELSE greatest({mid} - {half}, 0) END, 6) AS {name}_lower, round(CASE WHEN {a} = {b} THEN 1 ELSE least({mid} + {half}, 1) END, 6) AS {name}_upper"


_F1 = "(2.0 * {0} / nullif(2.0 * {0} + {1} + {2}, 0))::DOUBLE"
_PR = _P + """, g AS (SELECT p AS threshold, count(*) FILTER (label) AS t, count(*) FILTER (NOT label) AS f FROM d GROUP BY p),
  c AS (SELECT threshold, sum(t) OVER w AS tp, sum(f) OVER w AS fp, sum(t) OVER () AS al FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / (tp + fp) AS precision, tp / nullif(al, 0) AS recall FROM c)"""
_BINS = _P + """, b AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(label::INT) AS fr FROM d GROUP BY 1),
  r AS (SELECT i::INT AS bin, i / 10.0::DOUBLE AS lower, (i + 1) / 10.0::DOUBLE AS upper, coalesce(n, 0) AS count, mp, fr, abs(mp - fr) AS gap, coalesce(abs(mp - fr), 0) * coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (), 1) AS contribution FROM range(10) t(i) LEFT JOIN b ON b.bin = i)"""
_R = """WITH r AS (SELECT item_id, rater_id, arg_max(label, (rated_at, label)) AS label FROM (SELECT * REPLACE (regexp_replace(lower(regexp_replace(label, '^\\s+|\\s+$', '', 'g')), '[ -]', '_', 'g') AS label) FROM agreement_ratings) WHERE label IN ('resolved', 'partly_resolved', 'unresolved', 'harmful') AND item_id IS NOT NULL AND rater_id IS NOT NULL GROUP BY ALL)"""
_V = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_TOP = _V + ", x AS (SELECT q.vec_id AS query_id, e.vec_id AS hit_id, {0} AS dist FROM e q, e WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, hit_id) AS rank FROM x) SELECT query_id, hit_id, rank, round(dist, 5) AS distance FROM k WHERE rank <= 5"

SQL = {
    "confusion_matrix": _C + " SELECT (SELECT count(*) FROM p) AS attempted, (SELECT count(*) FROM d) AS decided, tp, fp, tn, fn FROM c",
    "wilson_intervals": _C + f" SELECT {_w('precision', 'tp', '(tp + fp)')}, {_w('recall', 'tp', '(tp + fn)')}, {_w('specificity', 'tn', '(tn + fp)')}, round({_F1.format('tp', 'fp', 'fn')}, 6) AS f1, round(({_F1.format('tp', 'fp', 'fn')} + {_F1.format('tn', 'fn', 'fp')}) / 2, 6) AS macro_f1, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c",
    "brier_score": _P + " SELECT round(avg((p - label::INT) ** 2), 6) AS brier FROM d",
    "reliability_bins": _BINS + " SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count, round(mp, 6) AS mean_predicted, round(fr, 6) AS failure_rate, round(gap, 6) AS gap, round(contribution, 6) AS contribution FROM r",
    "expected_calibration_error": _BINS + " SELECT round(sum(contribution), 6) AS ece FROM r",
    "precision_recall_curve": _PR + " SELECT round(threshold, 6) AS threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM k",
    "precision_recall_areas": _PR + ", s AS (SELECT *, recall - coalesce(lag(recall) OVER w, 0) AS st, coalesce(lag(precision) OVER w, 1) AS pp FROM k WINDOW w AS (ORDER BY threshold DESC)) SELECT round(sum(st * precision), 6) AS average_precision, round(sum(st * (precision + pp) / 2), 6) AS auprc FROM s",
    "selective_risk": _P
    + """, s AS (SELECT CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS conf, (p >= 0.5) <> label AS e FROM d), g AS (SELECT conf, count(*) AS n, count(*) FILTER (e) AS e FROM s GROUP BY conf),
      c AS (SELECT conf, CAST(sum(n) OVER w AS BIGINT) AS n, sum(e) OVER w AS e FROM g WINDOW w AS (ORDER BY conf DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT NULL, 0, 0)
      SELECT n AS decided_count, (SELECT count(*) FROM p) AS attempted_count, round(n / (SELECT count(*) FROM p), 6) AS coverage, round(e / nullif(n, 0), 6) AS classification_risk, round(conf, 6) AS minimum_confidence FROM c""",
    "rating_agreement": _R
    + """, c AS (SELECT item_id, label, count(*) AS n FROM r GROUP BY ALL), i AS (SELECT item_id, sum(n) AS m, sum(n * n) AS sq, count(*) AS k FROM c GROUP BY item_id), o AS (SELECT sum(m * (m - 1)) AS pairs, sum(m * m - sq) AS dis FROM i WHERE m >= 2),
      t AS (SELECT sum(t) AS n, sum(t * t) AS t2 FROM (SELECT label, sum(n) AS t FROM c WHERE item_id IN (SELECT item_id FROM i WHERE m >= 2) GROUP BY label))
      SELECT (SELECT count(DISTINCT item_id) FROM r) AS item_count, (SELECT count(DISTINCT rater_id) FROM r) AS rater_count, (SELECT count(*) FROM r) AS rating_count, (SELECT count(*) FROM i WHERE k > 1) AS disagreement_items,
        round(1 - (dis / pairs) / ((n * n - t2) / (n * (n - 1))), 6) AS krippendorff_alpha FROM o, t""",
    "two_rater_kappas": _R
    + """, top AS (SELECT rater_id FROM r GROUP BY rater_id ORDER BY count(*) DESC, rater_id LIMIT 2), q AS (SELECT item_id, list(label ORDER BY rater_id) AS l FROM r WHERE rater_id IN (SELECT rater_id FROM top) GROUP BY item_id HAVING count(*) = 2),
      s(l, i) AS (VALUES ('resolved', 0), ('partly_resolved', 1), ('unresolved', 2), ('harmful', 3)), ab AS (SELECT a.i AS a, b.i AS b FROM q JOIN s a ON a.l = q.l[1] JOIN s b ON b.l = q.l[2]), n AS (SELECT count(*)::DOUBLE AS n FROM ab),
      e AS (SELECT sum(CASE WHEN x.a = y.b THEN x.n * y.n ELSE 0 END) AS e, sum(x.n * y.n * (x.a - y.b) ** 2 / 9.0::DOUBLE) AS we FROM (SELECT a, count(*) AS n FROM ab GROUP BY a) x, (SELECT b, count(*) AS n FROM ab GROUP BY b) y)
      SELECT CAST(n AS BIGINT) AS n, round(((SELECT count(*) FROM ab WHERE a = b) / n - e / (n * n)) / (1 - e / (n * n)), 6) AS cohen_kappa, round(1 - ((SELECT sum((a - b) ** 2 / 9.0::DOUBLE) FROM ab) / n) / (we / (n * n)), 6) AS weighted_kappa FROM n, e""",
    "nearest_centroid": _V
    + """, x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT printf('c%03d', label) AS id, list(x ORDER BY i) AS v FROM m GROUP BY label),
      k AS (SELECT vec_id, arg_min(c.id, (1 - list_cosine_similarity(e.v, c.v), c.id)) AS nearest_id, min(1 - list_cosine_similarity(e.v, c.v)) AS d FROM e, c GROUP BY vec_id)
      SELECT vec_id, nearest_id, round(d, 6) AS distance, CASE WHEN d > 0.9 THEN 'unclustered' ELSE nearest_id END AS cluster_id, round(CASE WHEN d > 0.9 THEN 0 ELSE least(greatest(1 - d / 2, 0), 1) END, 6) AS confidence, d > 0.9 AS novelty FROM k""",
    "vector_topk_cosine": _TOP.format("1 - list_cosine_similarity(q.v, e.v)"),
    "vector_topk_euclidean": _TOP.format("list_distance(q.v, e.v)"),
    "vector_topk_inner_product": _TOP.format("-list_inner_product(q.v, e.v)"),
    "silhouette_by_cluster": _V
    + """, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE 1 - list_cosine_similarity(a.v, b.v) END) AS s FROM e a, e b GROUP BY ALL),
      m AS (SELECT vec_id, own, max(CASE WHEN own = other THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d JOIN n ON n.label = other GROUP BY ALL)
      SELECT own AS label, count(*) AS size, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM m GROUP BY own""",
}
