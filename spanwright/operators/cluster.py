"""Assignment of cases to clusters, cluster models over embeddings, vector search.

Vectors travel as arrays and are worked on as matrices, a batch at a time. Query vectors and centroids are sent to all tasks in blocks of
bounded size; rows of the table never meet each other in pairs.

Defined results: distances of vectors without length are 1 (cosine); ties go to the first centroid or the smaller row id; a null vector is
at no distance from anything (no row); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.functions.text import ascii_lower, trim_u
from spanwright.operators.slices import hashed_sample

QUERY_BLOCK = 4096
MOST_CENTROIDS = 100_000
FALLBACK = "unclustered"


# --- rules -------------------------------------------------------------------------------------------------------------------


def metadata_rule(cases: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = ("cluster_id", "cluster", "task_cluster"), tag_keys: tuple[str, ...] = ("tags",)) -> DataFrame:
    """(case_id, cluster_id, confidence): the first of a case's metadata values, in the order of the keys, that is a cluster's id, label or tag."""
    tags = [F.coalesce(F.from_json(F.try_element_at("metadata", F.lit(k)), "array<string>"), F.array().cast("array<string>")) for k in tag_keys]
    values = F.array_compact(F.concat(F.array(*[F.try_element_at("metadata", F.lit(k)) for k in keys]), *tags))
    c = cases.select(F.col("id").alias("case_id"), F.posexplode(values).alias("_k", "_v")).withColumn("_v", trim_u(F.col("_v")))
    k = clusters.withColumn("_n", F.monotonically_increasing_id()) if "ord" not in clusters.columns else clusters.withColumn("_n", F.col("ord"))
    tag = F.col("metadata.tag") if "metadata" in clusters.columns else F.lit(None).cast("string")
    k = k.select("_n", F.col("id").alias("cluster_id"), F.explode(F.array_distinct(F.array_compact(F.array("id", "label", tag)))).alias("_v"))
    hit = c.join(k, "_v").groupBy("case_id").agg(F.min_by("cluster_id", F.struct("_k", "_n")).alias("cluster_id"))
    return hit.withColumn("confidence", F.lit(1.0))


def keyword_rule(cases: DataFrame, clusters: DataFrame, base: float = 0.6, more: float = 0.1, most: float = 0.9) -> DataFrame:
    """(case_id, cluster_id, confidence): the cluster with most keywords (label, tag, keywords) in the case's texts; of equals the first.

    Clusters are a small dimension: its keywords are one array that each case is held against.
    """
    if clusters.count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} clusters")
    has_meta = "metadata" in clusters.columns
    words = F.array_distinct(F.filter(F.transform(F.array_compact(F.concat(F.array("label", F.col("metadata.tag") if has_meta else F.lit(None).cast("string")), F.coalesce("metadata.keywords", F.array().cast("array<string>")) if has_meta else F.array().cast("array<string>"))), lambda x: ascii_lower(trim_u(x))), lambda x: x != ""))
    order = F.col("ord") if "ord" in clusters.columns else F.monotonically_increasing_id()
    k = clusters.select(F.struct(order.cast("long").alias("n"), "id", words.alias("w")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("_k"))
    text = ascii_lower(F.concat_ws("\n", "input", "actual_output", "expected_output", "rubric"))
    c = cases.select(F.col("id").alias("case_id"), text.alias("_t")).crossJoin(F.broadcast(k))  # one row of clusters
    scored = F.transform("_k", lambda s: F.struct(F.size(F.filter(s["w"], lambda x: F.contains(F.col("_t"), x))).alias("hits"), (-s["n"]).alias("n"), s["id"].alias("id")))
    best = F.array_max(scored)
    c = c.select("case_id", best.alias("b")).filter("b.hits > 0")
    return c.select("case_id", F.col("b.id").alias("cluster_id"), F.least(base + (F.col("b.hits") - 1) * more, F.lit(most)).alias("confidence"))


def assign_by_rules(cases: DataFrame, clusters: DataFrame, rules: dict | None = None, fallback: str = FALLBACK) -> DataFrame:
    """(case_id, trace_id, cluster_id, confidence, method): the first rule that finds a cluster, else the fallback with confidence 0.

    ``rules``: name to function (cases, clusters) -> rows (case_id, cluster_id, confidence).
    """
    out = cases.select(F.col("id").alias("case_id"), "trace_id").dropDuplicates(["case_id"])
    rules = rules or {"metadata": metadata_rule, "keyword": keyword_rule}
    tries = []
    for name, rule in rules.items():
        r = rule(cases, clusters).select("case_id", F.struct("cluster_id", "confidence", F.lit(name).alias("method")).alias(f"_{name}"))
        out = out.join(r, "case_id", "left")
        tries.append(F.col(f"_{name}"))
    got = F.coalesce(*tries, F.struct(F.lit(fallback).alias("cluster_id"), F.lit(0.0).alias("confidence"), F.lit("fallback").alias("method")))
    return out.select("case_id", "trace_id", got.alias("g")).select("case_id", "trace_id", "g.*")


def with_assignments(results: DataFrame, assignments: DataFrame) -> DataFrame:
    """Results with the cluster that their case was assigned to (of several the greatest ``ord``, if there), else their own."""
    by = F.col("ord") if "ord" in assignments.columns else F.lit(0)
    a = assignments.groupBy("case_id").agg(F.max_by("cluster_id", by).alias("_c"))
    own = F.col("cluster_id") if "cluster_id" in results.columns else F.lit(None).cast("string")
    return results.join(a, "case_id", "left").withColumn("cluster_id", F.coalesce("_c", own)).drop("_c")


# --- distances ---------------------------------------------------------------------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between rows of a and rows of b: ``cosine``, ``euclidean`` or ``negative_inner_product``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot = a @ b.T
    if metric == "negative_inner_product":
        return -dot
    if metric == "cosine":
        n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return 1.0 - np.divide(dot, n, out=np.zeros_like(dot), where=n > 0)
    if metric == "euclidean":
        return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * dot))
    raise ValueError(f"no metric {metric}")


def confidence_of(distance: Column, metric: str = "cosine") -> Column:
    c = 1 - distance / 2 if metric == "cosine" else 1 - distance / (1 + distance)
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector, their matrix) of a list column."""
    ok = np.flatnonzero(~np.asarray(col.is_null()))
    if not len(ok):
        return ok, np.zeros((0, 0))
    v = col.take(pa.array(ok))
    size = v.value_lengths().to_numpy()
    if (size != size[0]).any():
        raise ValueError("vectors of different dimensions")
    return ok, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ok), int(size[0]))


def _block(df: DataFrame, key: str, vector: str, most: int, what: str) -> tuple[list, np.ndarray]:
    if df.count() > most:
        raise ValueError(f"more than {most} {what}")
    rows = df.filter(F.col(vector).isNotNull()).select(key, vector).orderBy(key).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def nearest_centroid(vectors: DataFrame, key: str, vector: str, centroids: DataFrame, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(key, ``nearest_id`` string, ``distance``, ``cluster_id``, ``confidence``, ``novelty``) with centroids (id, centroid); beyond the threshold the cluster is the fallback."""
    ids, c = _block(centroids, "id", "centroid", MOST_CENTROIDS, "centroids")
    kind = vectors.schema[key].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast((ids, c))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = sent.value
        for b in parts:
            ok, x = _matrix(b.column(1))
            if not len(ok) or not len(names):
                continue
            d = distances(x, c, metric)
            at = d.argmin(1)
            yield pa.RecordBatch.from_pydict({key: b.column(0).take(pa.array(ok)), "nearest_id": pa.array([str(names[i]) for i in at]), "distance": pa.array(d[np.arange(len(at)), at])})

    near = vectors.select(key, vector).mapInArrow(work, f"`{key}` {kind}, nearest_id string, distance double")
    novel = F.lit(False) if threshold is None else F.col("distance") > threshold
    return near.select("*", F.when(novel, F.lit(FALLBACK)).otherwise(F.col("nearest_id")).alias("cluster_id"), F.when(novel, 0.0).otherwise(confidence_of(F.col("distance"), metric)).alias("confidence"), novel.alias("novelty"))


def top_k(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", allowed: DataFrame | None = None) -> DataFrame:
    """(``query_id``, ``hit_id``, ``distance``, ``rank``): exact nearest rows of each query, itself included. ``allowed`` (key) limits the rows.

    Queries go in blocks of ``QUERY_BLOCK``; each batch of rows keeps its best ``k`` a query, and only those move.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    rows = table if allowed is None else table.join(allowed.select(key), key, "left_semi")
    return _search(queries, rows.select(key, vector), key, vector, k, metric, None)


def _search(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, metric: str, probes: object) -> DataFrame:
    kind = queries.schema[key].dataType.simpleString()
    spark = queries.sparkSession
    q = queries.filter(F.col(vector).isNotNull()).select(key, vector)
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    out = None
    for n in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == n)
        got = [(r[0], r[1]) for r in part.toLocalIterator()]
        ids, x = [g[0] for g in got], np.array([g[1] for g in got], np.float64)
        lists = probes(x) if probes is not None and len(ids) else None
        sent = spark.sparkContext.broadcast((ids, x, lists))

        def work(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, x, lists = sent.value
            qs, hs, ds = [], [], []
            for b in parts:
                ok, m = _matrix(b.column(1))
                if not len(ok) or not len(ids):
                    continue
                d = distances(x, m, metric)
                if lists is not None:
                    d = np.where(lists[:, b.column(2).take(pa.array(ok)).to_numpy()], d, np.inf)
                keys = b.column(0).take(pa.array(ok))
                order = np.argsort(np.array(keys.to_pylist()), kind="stable")
                d = d[:, order]
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                for i in range(len(ids)):
                    got = best[i][np.isfinite(d[i, best[i]])]
                    qs += [ids[i]] * len(got)
                    hs.append(keys.take(pa.array(order[got])))
                    ds.append(d[i, got])
                if len(qs) > 200_000:
                    yield _hits(qs, hs, ds, keys.type)
                    qs, hs, ds = [], [], []
            if qs:
                yield _hits(qs, hs, ds, hs[0].type)

        found = rows.mapInArrow(work, f"query_id {kind}, hit_id {kind}, distance double")
        out = found if out is None else out.unionByName(found)
    w = W.partitionBy("query_id").orderBy("distance", "hit_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _hits(qs: list, hs: list, ds: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"query_id": pa.array(qs, kind), "hit_id": pa.concat_arrays(hs), "distance": pa.array(np.concatenate(ds))})


# --- models ------------------------------------------------------------------------------------------------------------------


def fit_centroids(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, tolerance: float = 1e-4, spherical: bool = True) -> np.ndarray:
    """k-means with spread-out starts on a matrix in memory."""
    r = np.random.default_rng(seed)
    x = x.astype(np.float64)
    if spherical:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    k = min(k, len(x))
    c = x[[int(r.integers(len(x)))]]
    near = ((x - c[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = near.sum()
        i = int(r.integers(len(x))) if total <= 0 else int(np.searchsorted(np.cumsum(near), r.random() * total).clip(0, len(x) - 1))
        c = np.r_[c, x[[i]]]
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
    for _ in range(rounds):
        at = distances(x, c, "euclidean").argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        moved = float(np.sqrt(((new - c) ** 2).sum(1)).max())
        c = new
        if moved <= tolerance:
            break
    return c


def _sample(table: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    rows = hashed_sample(table.filter(F.col(vector).isNotNull()).select(key, vector), key, n)
    return np.array([r[vector] for r in rows], np.float64)


def discover(table: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", sample: int = 50_000, representatives: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(clusters, assignments): k clusters fitted on ``sample`` rows (least hashes), all rows assigned to the nearest centroid.

    Clusters (``id`` cluster-0001 by falling size, ``size``, ``centroid``, ``mean_distance``, ``radius``, ``representatives`` nearest first);
    assignments (key, ``cluster_id``, ``distance``).
    """
    from spanwright.session import Scratch

    scratch = Scratch(table.sparkSession, "clusters")
    c = fit_centroids(_sample(table, key, vector, sample), k, seed, spherical=metric == "cosine")
    spark = table.sparkSession
    raw = spark.createDataFrame([(f"{i:06d}", [float(v) for v in row]) for i, row in enumerate(c)], "id string, centroid array<double>")
    near = scratch.keep(nearest_centroid(table, key, vector, raw, metric).select(key, F.col("nearest_id").alias("_c"), "distance"))
    g = near.groupBy("_c").agg(F.count(F.lit(1)).alias("size"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("radius"))
    g = g.withColumn("id", F.format_string("cluster-%04d", F.row_number().over(W.orderBy(F.desc("size"), "_c"))))
    best = near.withColumn("_r", F.row_number().over(W.partitionBy("_c").orderBy("distance", key))).filter(F.col("_r") <= representatives)
    reps = best.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_r", key))).alias("_l")).select("_c", F.col(f"_l.{key}").alias("representatives"))
    clusters = scratch.keep(g.join(reps, "_c").join(raw.withColumnRenamed("id", "_c"), "_c").select("id", "size", "centroid", "mean_distance", "radius", "representatives", "_c"))
    return clusters.drop("_c"), near.join(clusters.select("_c", F.col("id").alias("cluster_id")), "_c").select(key, "cluster_id", "distance")


def silhouettes(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(``label``, ``size``, ``silhouette``): exact mean cosine silhouettes of all rows.

    The mean cosine distance of a row to a cluster is 1 minus its unit vector times the mean of the cluster's unit vectors, so that sums a
    cluster replace pairs of rows.
    """
    def unit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, list] = {}
        type_ = None
        for b in parts:
            type_ = b.column(0).type
            ok, x = _matrix(b.column(1))
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x, np.float64), where=n > 0)
            labels = b.column(0).take(pa.array(ok)).to_pylist()
            for y in dict.fromkeys(labels):
                at = np.array([z == y for z in labels])
                s = sums.setdefault(y, [0, 0.0])
                s[0] += int(at.sum())
                s[1] = s[1] + x[at].sum(0)
        if sums:
            yield pa.RecordBatch.from_pydict({"l": pa.array(list(sums), type_), "n": [s[0] for s in sums.values()], "v": [s[1].tolist() for s in sums.values()]})

    kind = table.schema[label].dataType.simpleString()
    rows = table.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    parts = rows.select(label, vector).mapInArrow(unit, f"l {kind}, n bigint, v array<double>").select("l", "n", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("l", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).groupBy("l").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("l", "n", F.col("v.x").alias("v"))
    if sums.count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} clusters")
    got = sums.orderBy("l").collect()
    names, n, v = [r[0] for r in got], np.array([r[1] for r in got], float), np.array([r[2] for r in got], float)
    sent = table.sparkSession.sparkContext.broadcast((names, n, v))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, v = sent.value
        place = {x: i for i, x in enumerate(names)}
        for b in batches:
            ok, x = _matrix(b.column(1))
            if not len(ok):
                continue
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x, np.float64), where=norm > 0)
            own = np.array([place[y] for y in b.column(0).take(pa.array(ok)).to_pylist()])
            total = n[None, :] - x @ v.T  # sums of distances to all rows of each cluster
            r = np.arange(len(own))
            self_d = 1.0 - (x * x).sum(1)
            a = np.where(n[own] > 1, (total[r, own] - self_d) / np.maximum(n[own] - 1, 1), 0.0)
            mean = total / n[None, :]
            mean[r, own] = np.inf
            best = mean.min(1) if len(n) > 1 else np.zeros(len(own))
            top = np.maximum(a, best)
            s = np.divide(best - a, top, out=np.zeros_like(top), where=top > 0)
            yield pa.RecordBatch.from_pydict({label: b.column(0).take(pa.array(ok)), "s": pa.array(s)})

    scored = rows.select(label, vector).mapInArrow(work, f"`{label}` {kind}, s double")
    return scored.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.avg("s").alias("silhouette")).filter(F.lit(len(names) > 1))


class InvertedLists:
    """An index of lists around coarse centroids: fitted on a bounded sample, holding every row; a search reads the ``probes`` nearest lists of each query."""

    def __init__(self, table: DataFrame, key: str, vector: str, lists: int = 64, metric: str = "cosine", sample: int = 50_000, seed: int = 42) -> None:
        self.key, self.vector, self.metric = key, vector, metric
        self.centroids = fit_centroids(_sample(table, key, vector, sample), lists, seed, rounds=25, spherical=metric == "cosine")
        c = self.centroids
        kind, vkind = table.schema[key].dataType.simpleString(), table.schema[vector].dataType.simpleString()

        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                ok, x = _matrix(b.column(1))
                if len(ok):
                    t = b.take(pa.array(ok))
                    yield pa.RecordBatch.from_pydict({key: t.column(0), vector: t.column(1), "list_id": pa.array(distances(x, c, metric if metric != "negative_inner_product" else "euclidean").argmin(1).astype(np.int32))})

        #: (key, vector, list_id); written with ``partitionBy("list_id")`` a search of few queries reads few folders.
        self.rows = table.select(key, vector).mapInArrow(work, f"`{key}` {kind}, `{vector}` {vkind}, list_id int")

    def search(self, queries: DataFrame, k: int, probes: int = 16) -> DataFrame:
        c, metric = self.centroids, self.metric if self.metric != "negative_inner_product" else "euclidean"

        def chosen(x: np.ndarray) -> np.ndarray:
            d = distances(x, c, metric)
            out = np.zeros(d.shape, bool)
            np.put_along_axis(out, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
            return out

        return _search(queries, self.rows, self.key, self.vector, k, self.metric, chosen)


def dbscan(*_: object, **__: object) -> None:
    """Density clustering is named in the interface but not implemented."""
    raise NotImplementedError("density clustering is not implemented; use discover()")


def eval_clusters(model: DataFrame) -> DataFrame:
    """Clusters of a model as (id, label, description, weight, metadata): an unlabelled one is called by its id."""
    label = F.coalesce("label", "id") if "label" in model.columns else F.col("id")
    text = F.col("description") if "description" in model.columns else F.lit(None).cast("string")
    return model.select("id", label.alias("label"), text.alias("description"), F.lit(1.0).alias("weight"), F.create_map(F.lit("cluster_size"), F.col("size").cast("string"), F.lit("cluster_radius"), F.col("radius").cast("string")).alias("metadata"))


def validate_model(model: DataFrame, assignments: DataFrame) -> DataFrame:
    """Issues (``code``, ``id``) of a cluster model: repeated or blank ids, sizes that differ from the assignments, assignments to unknown clusters, no centroid."""
    n = assignments.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    of = lambda df, code: df.select(F.lit(code).alias("code"), "id")
    out = of(model.groupBy("id").count().filter("count > 1"), "duplicate_cluster").unionByName(of(model.filter(F.coalesce(trim_u(F.col("id")) == "", F.lit(True))), "missing_cluster_id"))
    out = out.unionByName(of(model.join(n, "id", "left").filter(F.coalesce("_n", F.lit(0)) != F.col("size")), "size_mismatch")).unionByName(of(n.filter(F.col("id") != FALLBACK).join(model.select("id"), "id", "left_anti"), "unknown_cluster"))
    return out.unionByName(of(model.filter(F.col("centroid").isNull() | (F.size("centroid") < 1)), "missing_centroid"))


def row_map(records: DataFrame, external: str) -> DataFrame:
    """(``row_id`` bigint from 0, ``external_id``): numbers for the distinct external ids, in their order. Numbering is by sorted ranges, no single task."""
    ids = records.filter(F.col(external).isNotNull()).select(F.col(external).cast("string").alias("external_id")).distinct().repartitionByRange("external_id").sortWithinPartitions("external_id")
    from spanwright.session import Scratch

    kept = Scratch(records.sparkSession, "rows").keep(ids.withColumn("_p", F.spark_partition_id()))
    n = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = n.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    at = F.row_number().over(W.partitionBy("_p").orderBy("external_id")) - 1
    return kept.withColumn("_i", at).join(F.broadcast(base), "_p").select((F.col("_i") + F.col("_b")).cast("long").alias("row_id"), "external_id")


def unmapped(rows: DataFrame, mapping: DataFrame, external: str) -> DataFrame:
    """Rows whose external id has no number."""
    return rows.join(mapping.select(F.col("external_id").alias(external)), external, "left_anti")
