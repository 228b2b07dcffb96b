"""Agreement, calibration and risk statistics of binary predictions.

Predictions are rows (probability ``p`` of failure, boolean ``label`` of failure); rows with a null ``p`` abstain. Curves group ties, so that no
order of equal values matters. Curves are windows over distinct values, of which there are as many as a model tells apart; areas come
from sums over them.

Defined results: rates with an empty denominator are null; empty tables give counts of 0 and null rates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.operators.slices import hashed_sample, running_over_all

# The quantile of the 95 % interval, and the bootstrap's seed and resamples.
Z95 = 1.959963984540054
BOOTSTRAP_SEED = 0x54544502
BOOTSTRAP_ROUNDS = 10_000


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(2 * a * b / F.nullif(a + b, F.lit(0.0)), F.lit(0.0)))


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """The 95 % score interval, exact at the ends."""
    n, p = trials.cast("double"), successes / F.nullif(trials, F.lit(0))
    z2 = Z95 * Z95
    d = 1 + z2 / n
    mid, half = (p + z2 / (2 * n)) / d, Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / d
    lower = F.when(trials > 0, F.when(successes == 0, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0))))
    upper = F.when(trials > 0, F.when(successes == trials, 1.0).otherwise(F.least(mid + half, F.lit(1.0))))
    return lower, upper


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: attempted, decided, tp, fp, tn, fn."""
    yes, ok = F.col("p") >= threshold, F.col("p").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("attempted"), F.count("p").alias("decided"), F.count_if(ok & yes & F.col("label")).alias("tp"), F.count_if(ok & yes & ~F.col("label")).alias("fp"), F.count_if(ok & ~yes & ~F.col("label")).alias("tn"), F.count_if(ok & ~yes & F.col("label")).alias("fn")
    )


def rates(c: DataFrame) -> DataFrame:
    """Of a row tp, fp, tn, fn: precision, recall and specificity with intervals, F1 of both classes, their mean, and the correlation of Matthews."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c
    for name, a, b in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("specificity", tn, tn + fp)):
        lo, hi = wilson(a, b)
        out = out.withColumns({name: ratio(a, b), f"{name}_lower": lo, f"{name}_upper": hi})
    out = out.withColumns({"f1": harmonic(ratio(tp, tp + fp), ratio(tp, tp + fn)), "_n1": harmonic(ratio(tn, tn + fn), ratio(tn, tn + fp))})
    d = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return out.withColumns({"macro_f1": (F.col("f1") + F.col("_n1")) / 2, "mcc": (tp * tn - fp * fn) / F.nullif(d, F.lit(0.0))}).drop("_n1")


def brier(df: DataFrame) -> DataFrame:
    return df.filter("p is not null").agg(F.avg((F.col("p") - F.col("label").cast("double")) ** 2).alias("brier"))


def reliability_bins(df: DataFrame, n: int = 10) -> DataFrame:
    """All ``n`` equal bins: ``bin``, bounds, ``count``, mean prediction, rate, gap, and the gap's share of the expected calibration error."""
    d = df.filter("p is not null").withColumn("bin", F.least(F.floor(F.col("p") * n), F.lit(n - 1)).cast("int"))
    g = d.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_predicted"), F.avg(F.col("label").cast("double")).alias("failure_rate"))
    all_ = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    g = all_.join(g, "bin", "left").withColumns({"count": F.coalesce("count", F.lit(0)), "gap": F.abs(F.col("mean_predicted") - F.col("failure_rate"))})
    total = F.greatest(F.sum("count").over(W.partitionBy(F.lit(0))), F.lit(1))
    return g.select("bin", (F.col("bin") / n).alias("lower"), ((F.col("bin") + 1) / n).alias("upper"), "count", "mean_predicted", "failure_rate", "gap", (F.coalesce("gap", F.lit(0.0)) * F.col("count") / total).alias("contribution"))


def expected_calibration_error(df: DataFrame, n: int = 10) -> DataFrame:
    return reliability_bins(df, n).agg(F.sum("contribution").alias("ece"))


def precision_recall_curve(df: DataFrame) -> DataFrame:
    """One row a distinct probability, from the highest: ``threshold``, ``tp``, ``fp``, ``precision``, ``recall``."""
    g = df.filter("p is not null").groupBy(F.col("p").alias("threshold")).agg(F.count_if("label").alias("_t"), F.count_if(~F.col("label")).alias("_f"))
    positives = g.agg(F.sum("_t").alias("_all"))
    g = running_over_all(g, "threshold", {"tp": "_t", "fp": "_f"}, descending=True).crossJoin(F.broadcast(positives))  # one row
    return g.select("threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), ratio(F.col("tp"), F.col("_all")).alias("recall"), F.col("_t").alias("new_tp"), F.col("_f").alias("new_fp"), F.col("_all").alias("positives"))


def precision_recall_areas(df: DataFrame) -> DataFrame:
    """One row: average precision (steps) and the area under the curve (trapezoids from precision 1 at recall 0)."""
    c = precision_recall_curve(df)
    tp, n = F.col("tp") - F.col("new_tp"), F.col("tp") + F.col("fp") - F.col("new_tp") - F.col("new_fp")  # of the point before
    c = c.withColumns({"_s": ratio(F.col("new_tp"), F.col("positives")), "_p": F.coalesce(ratio(tp, n), F.lit(1.0))})
    return c.agg(F.sum(F.col("_s") * F.col("precision")).alias("average_precision"), F.sum(F.col("_s") * (F.col("precision") + F.col("_p")) / 2).alias("auprc"))


def selective_risk(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The origin and one row a distinct confidence, from the highest: decided count, coverage of all attempted, risk, least confidence."""
    n = df.agg(F.count(F.lit(1)).alias("attempted_count"))
    yes = F.col("p") >= threshold
    d = df.filter("p is not null").select(F.when(yes, F.col("p")).otherwise(1 - F.col("p")).alias("minimum_confidence"), (yes != F.col("label")).alias("_e"))
    g = d.groupBy("minimum_confidence").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_e").alias("_e"))
    c = running_over_all(g, "minimum_confidence", {"decided_count": "_n", "_errors": "_e"}, descending=True).select("minimum_confidence", "decided_count", "_errors")
    c = c.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias("minimum_confidence"), F.lit(0).cast("long").alias("decided_count"), F.lit(0).cast("long").alias("_errors")))
    c = c.crossJoin(F.broadcast(n))
    return c.select("decided_count", "attempted_count", F.coalesce(ratio(F.col("decided_count"), F.col("attempted_count")), F.lit(0.0)).alias("coverage"), ratio(F.col("_errors"), F.col("decided_count")).alias("classification_risk"), "minimum_confidence")


def _mix(x: np.ndarray) -> np.ndarray:
    """The public SplitMix64 output function."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_macro_f1(counts: np.ndarray, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> tuple[float, float, int] | None:
    """(lower, upper, valid rounds) of the mean F1 over resampled groups; ``counts``: tp, fp, tn, fn by group, in the groups' order."""
    g = len(counts)
    if not g or not rounds:
        return None
    stats = []
    block = max(1, 2_000_000 // g)
    for at in range(0, rounds, block):
        k = min(block, rounds - at)
        with np.errstate(over="ignore"):
            draws = _mix(np.uint64(seed) + (np.arange(at * g, (at + k) * g, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        n, low = np.uint64(g), np.uint64(0xFFFFFFFF)
        index = ((draws >> np.uint64(32)) * n + (((draws & low) * n) >> np.uint64(32))) >> np.uint64(32)
        tp, fp, tn, fn = counts[index.astype(np.int64)].reshape(k, g, 4).sum(1).T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            def f1(hit: np.ndarray, wrong: np.ndarray, missed: np.ndarray) -> np.ndarray:
                p, r = hit / (hit + wrong), hit / (hit + missed)
                return np.where(np.isnan(p) | np.isnan(r), np.nan, np.where(p + r > 0, 2 * p * r / (p + r), 0.0))

            stats.append((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2)
    s = np.concatenate(stats)
    s = s[~np.isnan(s)]
    return (float(np.quantile(s, 0.025)), float(np.quantile(s, 0.975)), len(s)) if len(s) else None


MOST_GROUPS = 1_000_000


def grouped_bootstrap(df: DataFrame, group: str, threshold: float = 0.5, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """One row (``lower``, ``upper``, ``valid_rounds``, ``groups``). Only four counts a group reach the driver; more than ``MOST_GROUPS`` groups are an error."""
    c = confusion_by(df.filter("p is not null"), group, threshold)
    n = c.count()
    if n > MOST_GROUPS:
        raise ValueError(f"{n} groups; resampling on the driver takes at most {MOST_GROUPS}")
    rows = c.orderBy(group).collect()
    got = bootstrap_macro_f1(np.array([[r["tp"], r["fp"], r["tn"], r["fn"]] for r in rows], np.int64).reshape(-1, 4), rounds, seed)
    lo, hi, valid = got or (None, None, 0)
    return df.sparkSession.createDataFrame([(lo, hi, valid, n)], "lower double, upper double, valid_rounds bigint, groups bigint")


def confusion_by(df: DataFrame, group: str, threshold: float) -> DataFrame:
    yes = F.col("p") >= threshold
    return df.groupBy(group).agg(F.count_if(yes & F.col("label")).alias("tp"), F.count_if(yes & ~F.col("label")).alias("fp"), F.count_if(~yes & ~F.col("label")).alias("tn"), F.count_if(~yes & F.col("label")).alias("fn"))


def agreement(ratings: DataFrame) -> DataFrame:
    """One row of ratings (item_id, rater_id, label; one a rater and item): items, raters, ratings, items with disagreement, and nominal alpha over items with two or more."""
    c = ratings.groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("n"))
    i = c.groupBy("item_id").agg(F.sum("n").alias("_m"), F.sum(F.col("n") ** 2).alias("_sq"), F.count(F.lit(1)).alias("_labels"))
    pairable = i.filter("_m >= 2")
    observed = pairable.agg(F.sum(F.col("_m") * (F.col("_m") - 1)).alias("_pairs"), F.sum(F.col("_m") ** 2 - F.col("_sq")).alias("_dis"))
    totals = c.join(pairable.select("item_id"), "item_id", "left_semi").groupBy("label").agg(F.sum("n").alias("_t")).agg(F.sum("_t").alias("_N"), F.sum(F.col("_t") ** 2).alias("_T2"))
    heads = ratings.agg(F.count_distinct("item_id").alias("item_count"), F.count_distinct("rater_id").alias("rater_count"), F.count(F.lit(1)).alias("rating_count"))
    dis = i.agg(F.count_if(F.col("_labels") > 1).alias("disagreement_items"))
    d_o = F.col("_dis") / F.nullif(F.col("_pairs"), F.lit(0))
    d_e = (F.col("_N") ** 2 - F.col("_T2")) / F.nullif(F.col("_N") * (F.col("_N") - 1), F.lit(0))
    row = heads.crossJoin(dis).crossJoin(observed).crossJoin(totals)  # one row each
    return row.select("item_count", "rater_count", "rating_count", "disagreement_items", (1 - d_o / F.nullif(d_e, F.lit(0.0))).alias("krippendorff_alpha"))


def two_rater_kappas(ratings: DataFrame, scale: list[str]) -> DataFrame:
    """One row (``n``, ``cohen_kappa``, ``weighted_kappa``) of a panel of exactly two raters, over items that both rated; null for other panels."""
    who = F.array_sort(F.collect_list(F.struct("rater_id", "label")))
    p = ratings.groupBy("item_id").agg(who.alias("r")).filter(F.size("r") == 2).select(F.col("r")[0]["label"].alias("a"), F.col("r")[1]["label"].alias("b"))
    c = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ab = {x: c.groupBy(F.col(x).alias("label")).agg(F.sum("n").alias(f"n_{x}")) for x in "ab"}
    at = F.create_map(*[y for i, s in enumerate(scale) for y in (F.lit(s), F.lit(float(i)))])
    far = float(max(1, (len(scale) - 1) ** 2))
    total = c.agg(F.sum("n").alias("N"))
    weight = lambda x, y: (F.try_element_at(at, F.col(x)) - F.try_element_at(at, F.col(y))) ** 2 / far
    seen = c.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("_same"), F.sum(F.col("n") * weight("a", "b")).alias("_wo"))
    # The margins have one row a label of the scale.
    margins = ab["a"].withColumnRenamed("label", "la").crossJoin(F.broadcast(ab["b"].withColumnRenamed("label", "lb")))
    chance = margins.agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("n_a") * F.col("n_b")).otherwise(0)).alias("_e"), F.sum(F.col("n_a") * F.col("n_b") * weight("la", "lb")).alias("_we"))
    two = ratings.agg((F.count_distinct("rater_id") == 2).alias("_two"))
    row = total.crossJoin(seen).crossJoin(chance).crossJoin(two)
    n = F.col("N").cast("double")
    po, pe = F.col("_same") / n, F.col("_e") / (n * n)
    return row.select(
        F.coalesce("N", F.lit(0)).alias("n"), F.when(F.col("_two"), (po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("cohen_kappa"), F.when(F.col("_two"), 1 - (F.col("_wo") / n) / F.nullif(F.col("_we") / (n * n), F.lit(0.0))).alias("weighted_kappa")
    )


@dataclass
class Logistic:
    """A fitted model: standardised features, then a line, then a sigmoid."""

    features: list[str]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    rounds: int

    def predict(self, df: DataFrame, into: str = "p") -> DataFrame:
        z = F.lit(self.intercept)
        for f, m, s, c in zip(self.features, self.means, self.scales, self.coefficients):
            z = z + (F.coalesce(F.col(f).cast("double"), F.lit(m)) - m) / s * c
        return df.withColumn(into, F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z))))


def fit_logistic(df: DataFrame, features: list[str], label: str, key: str, l2: float = 1.0, sample: int = 200_000, most_rounds: int = 10_000, tolerance: float = 1e-8) -> Logistic:
    """Fits on ``sample`` rows, one a value of ``key``, those with the least hashes: mean log loss plus ``l2``/2 of the squared coefficients a row, by Newton steps with halving."""
    rows = df.filter(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("_y"), F.col(key).alias("_k"))
    got = sorted(hashed_sample(rows, "_k", sample), key=lambda r: str(r["_k"]))
    rows = np.array([[*(r[f"_{i}"] for i in range(len(features))), r["_y"]] for r in got], float).reshape(-1, len(features) + 1)
    y, x = rows[:, -1], rows[:, :-1]
    if len(y) == 0 or y.min() == y.max():
        raise ValueError("a fit needs both classes")
    mean = np.nanmean(x, 0)
    x = np.where(np.isnan(x), mean, x)
    scale = x.std(0)
    scale[scale < 1e-12] = 1.0
    x = np.c_[np.ones(len(y)), (x - mean) / scale]
    ridge = np.r_[0.0, np.full(len(features), l2 / len(y))]

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * b * b))

    b, at, k = np.zeros(x.shape[1]), None, 0
    at = loss(b)
    for k in range(most_rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        grad = x.T @ (p - y) / len(y) + ridge * b
        if np.linalg.norm(grad) <= tolerance:
            break
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-12), grad)
        t = 1.0
        while t > 1e-12 and loss(b - t * step) > at:
            t /= 2
        if t <= 1e-12:
            break
        b = b - t * step
        at = loss(b)
    return Logistic(features, mean.tolist(), scale.tolist(), b[1:].tolist(), float(b[0]), k)
