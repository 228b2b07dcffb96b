"""Consensus labels, agreement and annotator reliability from disagreeing annotators.

Method: confidence-aware truth discovery. A label is a corner of the simplex of the scale; an item's truth is the point
with the least weighted squared distance to its labels, their weighted mean. An annotator's weight is the upper confidence
bound turned round: the chi-squared quantile at alpha/2 of as many degrees of freedom as they gave labels, over the sum
of their squared distances, so that annotators of the long tail, whose variance is uncertain, weigh less. Truths and
weights alternate until no weight changes by more than the share ``tolerance``. The consensus is the corner with the most weight.

Up to ``BROADCAST_ANNOTATORS`` annotators (counted) the votes are gathered by item once and written; an item then has at most one vote of
each. A round sends the annotators' weights out and gets sums of errors by annotator back, added up in each task first: no vote moves again.
Beyond that number the weights are joined to the votes, and a round aggregates (item, label) sums map-side, so that no item's rows have to meet
in one task; the results are the same. ``rounds`` says how many were needed, ``converged`` whether the weights came to rest. The quantile
is the Wilson-Hilferty cube, at least 0.001 a degree of freedom.

Defined results: rows with a null item, annotator or label, and labels that aren't of the scale, are not usable; of
several usable rows of an annotator for an item the latest counts (null times first, then the label that is first in the
alphabet); repeated rows count once; items of any number of annotators count for the fit and give a row (``n_annotators``); equal scores (to nine digits) go to
the label with more votes, then the one that is first in the alphabet. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import on_scale  # noqa: F401
from spanwright.session import Scratch

BROADCAST_ANNOTATORS = 100_000
BROADCAST_LABELS = 1_000


def usable(df: DataFrame, item: str, annotator: str, label: Column, at: str, least: int = 1) -> DataFrame:
    """Rows (``_i``, ``_a``, ``_l``): one label of each annotator for each item that has at least ``least`` annotators."""
    rows = df.select(F.col(item).alias("_i"), F.col(annotator).alias("_a"), label.alias("_l"), F.col(at).alias("_t"))
    last = rows.dropna(subset=["_i", "_a", "_l"]).groupBy("_i", "_a").agg(F.min(F.struct(F.col("_t").isNull(), (-F.unix_micros(F.col("_t").cast("timestamp"))).alias("u"), "_l")).alias("m"))
    last = last.select("_i", "_a", F.col("m._l").alias("_l"))
    if least <= 1:
        return last
    return last.join(last.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("_i"), "_i", "left_semi")


class Consensus:
    """``labels``, ``items`` and ``annotators`` are the results, as DataFrames."""

    def __init__(self, votes: DataFrame, alpha: float = 0.05, rounds: int = 30, tolerance: float = 0.01, annotators_limit: int | None = None) -> None:
        scratch = Scratch(votes.sparkSession, "consensus")
        votes = scratch.keep(votes)
        z = NormalDist().inv_cdf(alpha / 2)
        self.rounds, self.converged = 0, False
        if annotators_limit is None:
            annotators_limit = BROADCAST_ANNOTATORS
        who = votes.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"))
        who, kinds = scratch.keep(who), votes.select("_l").distinct()
        if who.count() <= annotators_limit and kinds.count() <= BROADCAST_LABELS:
            self._gathered(votes, who.orderBy("_a").collect(), [r[0] for r in kinds.orderBy("_l").collect()], scratch, z, rounds, tolerance)
        else:
            self._joined(votes, scratch, z, rounds, tolerance)

    def _gathered(self, votes: DataFrame, who: list, labels: list[str], scratch: Scratch, z: float, rounds: int, tolerance: float) -> None:
        spark = votes.sparkSession
        names = [r["_a"] for r in who]
        k = np.array([r["_n"] for r in who], float)
        codes = spark.createDataFrame([(a, i) for i, a in enumerate(names)], "_a string, _c int")
        at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("_l")) - 1 if labels else F.lit(0)
        table = votes.withColumn("_a", F.col("_a").cast("string")).join(F.broadcast(codes), "_a").select("_i", F.struct("_c", at.cast("int").alias("_k")).alias("v"))
        table = scratch.keep(table.groupBy("_i").agg(F.array_sort(F.collect_list("v")).alias("v")).select("_i", F.col("v._c").alias("a"), F.col("v._k").alias("l")))
        m, many = len(labels), len(names)
        w = np.ones(many)
        chi = np.maximum(k * (1 - 2 / (9 * k) + z * np.sqrt(2 / (9 * k))) ** 3, 0.001 * k) if many else k
        kind = votes.schema["_i"].dataType.simpleString()

        def scores(b: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, ...]:
            n = b.num_rows
            a, lab = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            row = np.repeat(np.arange(n), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            s = np.bincount(row * m + lab, weights=w[a], minlength=n * m).reshape(n, m)
            v = np.bincount(row * m + lab, minlength=n * m).reshape(n, m)
            return a, lab, row, s / s.sum(1, keepdims=True), v

        for _ in range(rounds if many else 0):
            sent = spark.sparkContext.broadcast(w)

            def errors(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                total = np.zeros(many)
                for b in parts:
                    if b.num_rows:
                        a, lab, row, t, _ = scores(b, sent.value)
                        total += np.bincount(a, weights=1 - 2 * t[row, lab] + (t * t).sum(1)[row], minlength=many)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"a": pa.array(some, pa.int64()), "e": pa.array(total[some])})

            e = np.zeros(many)
            for r in table.mapInArrow(errors, "a bigint, e double").groupBy("a").agg(F.sum("e").alias("e")).collect():
                e[r["a"]] = r["e"]
            # Half a label's distance at least, so that an annotator who never differs gets no boundless weight.
            new = chi / np.maximum(e, 0.5)
            moved = float(np.abs(np.log(new / w)).max())
            w, self.rounds = new, self.rounds + 1
            sent.unpersist()
            if moved <= tolerance:
                self.converged = True
                break
        last = spark.sparkContext.broadcast(w)

        def chosen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                if not b.num_rows:
                    continue
                _, _, _, t, v = scores(b, last.value)
                t = np.round(t, 9)
                # Of equal scores the label with more votes, then the first in the alphabet.
                best = np.lexsort((np.broadcast_to(-np.arange(m), t.shape), v, t))[:, -1]
                n = v.sum(1)
                pairs = (v * (v - 1)).sum(1)
                agree = pa.array(pairs / np.maximum(n * (n - 1), 1), mask=n < 2)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([labels[i] for i in best]), pa.array(n), pa.array(t[np.arange(len(n)), best]), agree], names=["_i", "label", "n_annotators", "confidence", "agreement"])

        self.items = scratch.keep(table.mapInArrow(chosen, f"_i {kind}, label string, n_annotators bigint, confidence double, agreement double"))
        weights = spark.createDataFrame([(a, float(x)) for a, x in zip(names, w)], "_a string, weight double")
        right = votes.withColumn("_a", F.col("_a").cast("string")).join(self.items.select("_i", "label"), "_i")
        self.annotators = right.groupBy("_a").agg(F.count(F.lit(1)).alias("n_labels"), F.avg((F.col("_l") == F.col("label")).cast("double")).alias("accuracy")).join(F.broadcast(weights), "_a")

    def _joined(self, votes: DataFrame, scratch: Scratch, z: float, rounds: int, tolerance: float) -> None:
        weights = scratch.keep(votes.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"), F.lit(1.0).alias("_w")))
        small = False
        for _ in range(rounds):
            scores, items = self._scores(votes, weights, small)
            near = scores.join(items, "_i").select("_i", "_l", (1 - 2 * F.col("_s") / F.col("_sum") + F.col("_sq") / F.col("_sum") ** 2).alias("_d"))
            k = F.col("_n").cast("double")
            chi = F.greatest(k * F.pow(1 - 2 / (9 * k) + z * F.sqrt(2 / (9 * k)), 3), 0.001 * k)
            # Half a label's distance at least, so that an annotator who never differs gets no boundless weight.
            new = votes.join(near, ["_i", "_l"]).groupBy("_a").agg(F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_e")).select("_a", "_n", (chi / F.greatest("_e", F.lit(0.5))).alias("_w"))
            new = scratch.keep(new)
            moved = new.join(weights.select("_a", F.col("_w").alias("_old")), "_a").agg(F.max(F.abs(F.log(F.col("_w") / F.col("_old"))))).first()[0]
            scratch.drop(weights)
            weights, self.rounds = new, self.rounds + 1
            if moved is None or moved <= tolerance:
                self.converged = True
                break
        scores, items = self._scores(votes, weights, small)
        best = F.struct((-F.round(F.col("_s") / F.col("_sum"), 9)).alias("s"), (-F.col("_v")).alias("v"), F.col("_l").alias("l"))
        chosen = scores.join(items, "_i").groupBy("_i").agg(F.min(best).alias("m"), F.sum("_v").alias("_n"), F.sum(F.col("_v") * (F.col("_v") - 1)).alias("_pairs"))
        self.items = chosen.select(
            "_i", F.col("m.l").alias("label"), F.col("_n").alias("n_annotators"), (-F.col("m.s")).alias("confidence"), F.when(F.col("_n") > 1, F.col("_pairs") / (F.col("_n") * (F.col("_n") - 1))).alias("agreement")
        )
        self.annotators = votes.join(self.items.select("_i", "label"), "_i").groupBy("_a").agg(F.count(F.lit(1)).alias("n_labels"), F.avg((F.col("_l") == F.col("label")).cast("double")).alias("accuracy")).join(weights.select("_a", F.col("_w").alias("weight")), "_a")

    @staticmethod
    def _scores(votes: DataFrame, weights: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
        w = weights.select("_a", "_w")
        scores = votes.join(F.broadcast(w) if small else w, "_a").groupBy("_i", "_l").agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_v"))
        return scores, scores.groupBy("_i").agg(F.sum("_s").alias("_sum"), F.sum(F.col("_s") ** 2).alias("_sq"))
