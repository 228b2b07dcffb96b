"""Hierarchies from parent-child links: path, depth, root, nested-set ranges, cycles.

Method: subtree sizes are summed upward from the leaves; sibling ranges of the preorder are then allocated
downward by prefix sums of those sizes, so that a node's descendants are exactly the nodes of its tree whose
``lft`` lies in (lft, rgt]. Nodes that the upward pass cannot process lie on cycles; nodes that it processes
but the downward pass does not reach hang below one.

Scopes (e.g. traces) with up to ``limit`` nodes are solved whole, many at a time, with array operations in one
Arrow pass after one shuffle. Larger scopes are solved by joins over all their nodes, with sums and ranges
doubled in distance each round, so that a chain of n nodes takes log2(n) rounds and no scope has to fit
into a task.

Result columns: the scope column, ``node_id``, ``root_id``, ``depth`` (bigint), ``lft``, ``rgt`` (bigint, preorder from
0 within the scope; null on and below cycles), ``subtree_size`` (bigint; null on and below cycles), ``status``
(``tree``, ``cycle``, ``below_cycle``) and, if asked for, ``path`` (array of ids from the root, null on and below
cycles).

Defined results: a node is a root if its parent is null or no node of its scope; a node on a cycle has depth -1, one
below a cycle -2, both with the smallest id on that cycle (byte order) as root. Rows with a null scope or id are no
nodes; of several rows of one (scope, id) the smallest non-null parent counts; blank ids are ids as any other. An empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.operators.slices import large_keys
from spanwright.session import Scratch

LIMIT = 200_000
SIBLING_BUCKETS = 256

_FIELDS = [
    ("scope", pa.string()),
    ("node_id", pa.string()),
    ("root_id", pa.string()),
    ("depth", pa.int64()),
    ("lft", pa.int64()),
    ("rgt", pa.int64()),
    ("subtree_size", pa.int64()),
    ("status", pa.string()),
]
_SPARK = T.StructType([T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in _FIELDS])


def solve(parent: np.ndarray, scope: np.ndarray, sibling_key: np.ndarray) -> dict[str, np.ndarray]:
    """The hierarchy of nodes 0..n-1, numbered in the byte order of (scope, id).

    ``parent``: index or -1. ``scope``: non-decreasing codes. ``sibling_key``: order among siblings, before the index.
    """
    n = len(parent)
    size = np.ones(n, np.int64)
    pending = np.bincount(parent[parent >= 0], minlength=n)
    done = np.zeros(n, bool)
    front = np.flatnonzero(pending == 0)
    while front.size:  # upward, one height a round
        done[front] = True
        up = front[parent[front] >= 0]
        p = parent[up]
        np.add.at(size, p, size[up])
        np.subtract.at(pending, p, 1)
        p = np.unique(p)
        front = p[(pending[p] == 0) & ~done[p]]
    cyclic = np.flatnonzero(~done)

    # Children by parent, roots by scope; each in sibling order, with the sizes of earlier siblings.
    group = np.where(parent >= 0, parent, n + scope)
    order = np.lexsort((np.arange(n), sibling_key, group))
    g = group[order]
    first = np.r_[True, g[1:] != g[:-1]] if n else np.zeros(0, bool)
    total = np.cumsum(size[order]) - size[order]
    before = np.empty(n, np.int64)
    before[order] = total - np.repeat(total[first], np.diff(np.r_[np.flatnonzero(first), n])) if n else 0
    child_at = np.searchsorted(g, np.arange(n))
    child_n = np.bincount(parent[parent >= 0], minlength=n)

    lft = np.full(n, -1, np.int64)
    depth = np.full(n, -1, np.int64)
    root = np.full(n, -1, np.int64)
    state = np.zeros(n, np.int8)

    def down(front: np.ndarray, ranges: bool) -> None:
        while front.size:
            c = child_n[front]
            front = front[c > 0]
            c = c[c > 0]
            at = np.repeat(child_at[front] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
            kids = order[at]
            kids = kids[root[kids] < 0]
            p = parent[kids]
            root[kids] = root[p]
            if ranges:
                depth[kids] = depth[p] + 1
                lft[kids] = lft[p] + 1 + before[kids]
            else:
                state[kids] = 2
                depth[kids] = -2
            front = kids

    top = np.flatnonzero(parent < 0)
    root[top], depth[top], lft[top] = top, 0, before[top]
    down(top, True)
    if cyclic.size:
        # The smallest index on each cycle, by doubling.
        least, jump, steps = np.arange(n), parent.copy(), 1
        while steps < 2 * cyclic.size:
            least[cyclic] = np.minimum(least[cyclic], least[jump[cyclic]])
            jump[cyclic] = jump[jump[cyclic]]
            steps *= 2
        root[cyclic], state[cyclic], depth[cyclic] = least[cyclic], 1, -1
        down(cyclic, False)
    return {"root": root, "depth": depth, "lft": lft, "size": size, "state": state}


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroups sorted batches into tables that hold whole scopes."""
    held: list[pa.Table] = []
    for b in parts:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        scope = t.column(0).combine_chunks()
        last = scope[-1]
        cut = pc.index(scope, last).as_py()
        if held and held[-1].column(0)[-1].as_py() == scope[0].as_py() and cut == 0:
            held.append(t)
            continue
        if cut or held:
            done = pa.concat_tables([*held, t.slice(0, cut)])
            if done.num_rows:
                yield done
        held = [t.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def _local(parts: Iterator[pa.RecordBatch], with_path: bool, with_ranges: bool) -> Iterator[pa.RecordBatch]:
    states = pa.array(["tree", "cycle", "below_cycle"])
    for t in _whole(parts):
        scope, ids, parents = (t.column(i).combine_chunks() for i in range(3))
        scope_id = pc.binary_join_element_wise(scope, ids, "\x00")
        # Repeated rows stand together; the sort puts the parent that counts first.
        codes = scope_id.dictionary_encode().indices.to_numpy()
        keep = np.r_[True, codes[1:] != codes[:-1]]
        if not keep.all():
            mask = pa.array(keep)
            scope, ids, parents, scope_id = (x.filter(mask) for x in (scope, ids, parents, scope_id))
        parent = pc.index_in(pc.binary_join_element_wise(scope, parents, "\x00"), value_set=scope_id)
        parent = pc.fill_null(parent, -1).to_numpy().astype(np.int64)
        s = scope.dictionary_encode().indices.to_numpy().astype(np.int64)
        key = np.fromiter((zlib.crc32(x.encode()) % SIBLING_BUCKETS for x in ids.to_pylist()), np.int64, len(ids)) if with_ranges else np.zeros(len(ids), np.int64)
        r = solve(parent, s, key)
        plain = pa.array(r["state"] != 0)
        null = pa.scalar(None, pa.int64())
        out = [
            scope,
            ids,
            ids.take(pa.array(r["root"])),
            pa.array(r["depth"]),
            pc.if_else(plain, null, pa.array(r["lft"])),
            pc.if_else(plain, null, pa.array(r["lft"] + r["size"] - 1)),
            pc.if_else(plain, null, pa.array(r["size"])),
            states.take(pa.array(r["state"].astype(np.int64))),
        ]
        names = [n for n, _ in _FIELDS]
        if with_path:
            name, path = ids.to_pylist(), [None] * len(ids)
            for i in np.lexsort((np.arange(len(ids)), r["depth"])):
                if r["state"][i] == 0:
                    path[i] = [*path[parent[i]], name[i]] if parent[i] >= 0 else [name[i]]
            out.append(pa.array(path, pa.list_(pa.string())))
            names.append("path")
        yield from pa.table(out, names=names).to_batches(max_chunksize=20_000)


def _doubled(nodes: DataFrame, value: str, scratch: Scratch) -> DataFrame:
    """Sums ``value`` along each node's way to its root: nodes (scope, id, parent null at roots)."""
    cur = nodes.select("scope", "id", F.col("parent").alias("anc"), F.col(value).alias("v"))
    cur = scratch.keep(cur)
    while not cur.filter("anc is not null").isEmpty():
        far = cur.select("scope", F.col("id").alias("anc"), F.col("anc").alias("_a"), F.col("v").alias("_v"))
        moved = cur.filter("anc is not null").join(far, ["scope", "anc"]).select("scope", "id", F.col("_a").alias("anc"), (F.col("v") + F.col("_v")).alias("v"))
        nxt = scratch.keep(cur.filter("anc is null").select("scope", "id", "anc", "v").unionByName(moved))
        scratch.drop(cur)
        cur = nxt
    return cur.select("scope", "id", F.col("v").alias(value))


def _distributed(links: DataFrame, scratch: Scratch, with_path: bool) -> DataFrame:
    nodes = scratch.keep(links.groupBy("scope", "id").agg(F.min("parent").alias("parent")))
    there = nodes.select("scope", F.col("id").alias("parent"), F.lit(True).alias("_there"))
    linked = nodes.join(there, ["scope", "parent"], "left").select("scope", "id", F.when(F.col("_there"), F.col("parent")).alias("parent"))
    up = F.col("parent").isNull()
    cur = scratch.keep(
        linked.select(
            "scope",
            "id",
            "parent",
            F.col("parent").alias("anc"),
            F.when(up, 0).otherwise(1).cast("long").alias("depth"),
            F.when(up, F.col("id")).alias("root"),
            F.col("id").alias("least"),
            F.lit(1).cast("long").alias("size"),
            (F.array("id") if with_path else F.lit(None).cast("array<string>")).alias("path"),
        )
    )
    nodes_n = 0
    left, rounds, most = None, 0, None
    while True:
        moving = cur.filter("anc is not null")
        n = moving.count()
        if n == 0:
            break
        if n == left and most is None:
            # A round in which no node reaches a root: all that move are on or below cycles, and the doubling has only
            # to go on until it spans the longest of them.
            most = moving.groupBy("scope").count().agg(F.max("count")).first()[0]
        if most is not None and 2**rounds >= most:
            break
        left = n
        far = cur.select(
            "scope",
            F.col("id").alias("anc"),
            F.col("anc").alias("_anc"),
            F.col("depth").alias("_depth"),
            F.col("root").alias("_root"),
            F.col("least").alias("_least"),
            F.col("path").alias("_path"),
        )
        moved = moving.join(far, ["scope", "anc"]).select(
            "scope",
            "id",
            "parent",
            F.col("_anc").alias("anc"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_root").alias("root"),
            F.least("least", "_least").alias("least"),
            "size",
            (F.when(F.lit(most is None), F.concat("_path", "path")) if with_path else F.col("path")).alias("path"),
        )
        # Subtree sizes upward: what stands 2^k to 2^(k+1)-1 steps below is what the nodes 2^k below have gathered.
        gained = moving.groupBy("scope", F.col("anc").alias("id")).agg(F.sum("size").alias("_gain"))
        nxt = cur.filter("anc is null").unionByName(moved).join(gained, ["scope", "id"], "left")
        nxt = scratch.keep(nxt.withColumn("size", F.col("size") + F.coalesce("_gain", F.lit(0))).drop("_gain"))
        scratch.drop(cur)
        cur, rounds, nodes_n = nxt, rounds + 1, n
    trees = cur.filter("anc is null")
    # Sibling ranges by prefix sums in two levels, so that a node with very many children is no single window.
    sibling = F.coalesce("parent", F.lit(None).cast("string"))
    bucket = (F.crc32(F.col("id").cast("binary")) % SIBLING_BUCKETS).cast("int")
    b = trees.withColumn("_b", bucket)
    sums = b.groupBy("scope", sibling.alias("_p"), "_b").agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("scope", "_p").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("scope", "_p", "_b", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = W.partitionBy("scope", "parent", "_b").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("l").join(
        sums.alias("r"), (F.col("l.scope") == F.col("r.scope")) & F.col("l.parent").eqNullSafe(F.col("r._p")) & (F.col("l._b") == F.col("r._b"))
    )
    step = b.select(
        "l.scope", "l.id", "l.parent", "l.depth", "l.root", "l.size", "l.path", (F.col("_in") + F.col("_base") + F.when(F.col("l.parent").isNull(), 0).otherwise(1)).alias("lft")
    )
    step = scratch.keep(step)
    pre = _doubled(step, "lft", scratch)
    out = step.drop("lft").join(pre, ["scope", "id"])
    null = F.lit(None).cast("long")
    tree = out.select(
        "scope", F.col("id").alias("node_id"), F.col("root").alias("root_id"), "depth", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), F.col("size").alias("subtree_size"), F.lit("tree").alias("status"), "path"
    )
    # After doubling beyond every length all that moves points onto its cycle, and each node of a cycle is pointed at.
    stuck = cur.filter("anc is not null")
    on = stuck.select("scope", F.col("anc").alias("id")).distinct().withColumn("_on", F.lit(True))
    cyc = stuck.join(on, ["scope", "id"], "left").join(stuck.select("scope", F.col("id").alias("anc"), F.col("least").alias("_c")), ["scope", "anc"])
    cyc = cyc.select(
        "scope",
        F.col("id").alias("node_id"),
        F.when(F.col("_on"), F.col("least")).otherwise(F.col("_c")).alias("root_id"),
        F.when(F.col("_on"), -1).otherwise(-2).cast("long").alias("depth"),
        null.alias("lft"),
        null.alias("rgt"),
        null.alias("subtree_size"),
        F.when(F.col("_on"), "cycle").otherwise("below_cycle").alias("status"),
        F.lit(None).cast("array<string>").alias("path"),
    )
    out = tree.unionByName(cyc)
    return out if with_path else out.drop("path")


def hierarchy(df: DataFrame, scope: str, node: str, parent: str, with_path: bool = False, limit: int = LIMIT, with_ranges: bool = True) -> DataFrame:
    """One row for each node; see the module's text. ``with_ranges=False`` leaves the order of siblings open."""
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = df.select(F.col(scope).cast("string").alias("scope"), F.col(node).cast("string").alias("id"), F.col(parent).cast("string").alias("parent")).filter(
        F.col("scope").isNotNull() & F.col("id").isNotNull()
    )
    big = large_keys(links, "scope", limit, scratch)
    small = links if big is None else links.join(big.select("scope"), "scope", "left_anti")
    schema = T.StructType(_SPARK.fields + ([T.StructField("path", T.ArrayType(T.StringType()))] if with_path else []))
    out = (
        small.repartition("scope")
        .sortWithinPartitions("scope", "id", F.asc_nulls_last("parent"))
        .mapInArrow(lambda parts: _local(parts, with_path, with_ranges), schema)
    )
    if big is not None:
        out = out.unionByName(_distributed(links.join(big.select("scope"), "scope", "left_semi"), scratch, with_path))
    return out.withColumnRenamed("scope", scope)


def members_below(tree: DataFrame, scope: str, asked: DataFrame) -> DataFrame:
    """Rows (scope, ``ancestor_id``, ``node_id``, ``distance``): all descendants of the nodes in ``asked`` (scope, ``node_id``).

    ``tree`` is a result of :func:`hierarchy`. The nested-set ranges of the asked nodes are cut at the granules of 1024
    preorder places that they touch, so that range membership becomes an equality of granules plus a comparison.
    """
    grain = 1024
    a = tree.join(asked.select(scope, "node_id").distinct(), [scope, "node_id"], "left_semi").filter("lft is not null and rgt > lft")
    a = a.select(scope, F.col("node_id").alias("ancestor_id"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"), F.col("depth").alias("_d"))
    a = a.withColumn("_g", F.explode(F.sequence(F.expr(f"(_l + 1) div {grain}"), F.expr(f"_r div {grain}"))))
    t = tree.filter("lft is not null").select(scope, "node_id", "lft", "depth").withColumn("_g", F.expr(f"lft div {grain}"))
    hit = (F.col("lft") > F.col("_l")) & (F.col("lft") <= F.col("_r"))
    return a.join(t, [scope, "_g"]).filter(hit).select(scope, "ancestor_id", "node_id", (F.col("depth") - F.col("_d")).alias("distance"))
