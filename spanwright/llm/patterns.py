"""Ordered patterns of steps that many sequences contain, with gaps allowed, and their exact supports.

Method: sequence decision diagrams. A sequence is first brought to a canonical short form with the same patterns. The
sequences of a block are then stored in one shared acyclic graph: a node is (step, rest), identical rests are one
node, and the database is a weighted set of nodes. Growing a pattern by a step maps the database to its conditional one
(each node to what follows the step's first occurrence), where equal nodes merge and their weights add; equal
conditional databases are mined once. Supports of blocks add up, so that each task counts its own sequences and only
(pattern, count) rows move.

Canonical form: the patterns of up to three steps in a sequence depend, for a middle step, only on which steps stand
before and which after it. These sets change only where some step occurs first or last; between two such places one
occurrence of each step, in fixed order, says all. The form is also a valid stand-in for the part of a longer
sequence, so that entities with more than ``limit`` events are shortened slice by slice.

Defined results: events with a null entity or null order don't count; repeated rows of one (entity, id) are one event; ties of
the order are settled by ``tie``, then id. The share is of the entities with at least one event. Empty tables give no
rows; columns of the input other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.llm.runs import _same
from spanwright.operators.slices import LIMIT, with_slices
from spanwright.session import Scratch

BLOCK_STEPS = 400_000
SMALL_ALPHABET = 10_000


def canonical(seq: list[int]) -> tuple[int, ...]:
    """A short sequence with the same subsequences of up to three steps, alone and within any context."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, x in enumerate(seq):
        first.setdefault(x, i)
        last[x] = i
    edge = {*first.values(), *last.values()}
    out: list[int] = []
    between: set[int] = set()
    for i, x in enumerate(seq):
        if i in edge:
            out += sorted(between)
            between = set()
            out.append(x)
        else:
            between.add(x)
    return tuple(out)


class Diagram:
    """Weighted sequences over steps 0..m-1 in one shared graph."""

    def __init__(self, sequences: Counter[tuple[int, ...]], m: int) -> None:
        nodes: dict[tuple[int, int], int] = {}
        head, tail = [0], [0]  # node 0: the empty rest
        start: Counter[int] = Counter()
        for seq, w in sequences.items():
            at = 0
            for x in reversed(seq):
                k = (x, at)
                at = nodes.get(k, 0)
                if not at:
                    at = nodes[k] = len(head)
                    head.append(x)
                    tail.append(k[1])
            if at:
                start[at] += w
        # after[v, x]: the rest behind the first x in v, or -1. Tails have smaller numbers.
        after = np.full((len(head), m), -1, np.int32)
        for v in range(1, len(head)):
            after[v] = after[tail[v]]
            after[v, head[v]] = tail[v]
        self.after = after
        self.start = np.array(sorted(start), np.int64), np.array([start[v] for v in sorted(start)], np.int64)
        self.memo: dict[tuple, list] = {}

    def given(self, db: tuple[np.ndarray, np.ndarray], x: int) -> tuple[np.ndarray, np.ndarray]:
        to = self.after[db[0], x]
        ok = to >= 0
        v, where = np.unique(to[ok], return_inverse=True)
        return v, np.bincount(where, weights=db[1][ok], minlength=len(v)).astype(np.int64)

    def mine(self, length: int, db: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[tuple[int, ...], int]]:
        """All patterns of exactly ``length`` steps with their weights."""
        db = self.start if db is None else db
        known = (length, db[0].tobytes(), db[1].tobytes())
        if known in self.memo:
            return self.memo[known]
        weight = (self.after[db[0]] >= 0).T @ db[1] if len(db[0]) else np.zeros(self.after.shape[1], np.int64)
        steps = np.flatnonzero(weight)
        if length == 1:
            out = [((int(x),), int(weight[x])) for x in steps]
        else:
            out = [((int(x), *p), w) for x in steps for p, w in self.mine(length - 1, self.given(db, x))]
        if length < 3:
            self.memo[known] = out
        return out


def _shorten(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, slice, canonical steps) from sorted events; repeated rows of an event stand together."""
    held: tuple | None = None
    last = None
    for b in parts:
        t = pa.Table.from_batches([b]).combine_chunks()
        if not t.num_rows:
            continue
        e, sl, ids, code, at = (t.column(n).chunk(0) for n in ("_e", "_slice", "_id", "_code", "_s"))
        fresh = np.r_[True, ~(_same(e) & _same(ids) & _same(at))]
        fresh[0] = last != (e[0].as_py(), ids[0].as_py(), at[0].as_py())
        last = (e[-1].as_py(), ids[-1].as_py(), at[-1].as_py())
        starts = np.flatnonzero(np.r_[True, ~(_same(e) & _same(sl))])
        codes = code.to_numpy()
        out: list[tuple] = []
        for i, j in zip(starts, [*starts[1:], len(codes)]):
            chunk, steps = (e[i].as_py(), sl[i].as_py()), codes[i:j][fresh[i:j]].tolist()
            if held and held[0] == chunk:
                steps = [*held[1], *steps]
            elif held:
                out.append((*held[0], canonical(held[1])))
            # A long chunk is shortened as it comes.
            held = (chunk, list(canonical(steps)) if len(steps) > 4096 else steps)
        if out:
            yield pa.RecordBatch.from_pydict({"_e": [x[0] for x in out], "_slice": pa.array([x[1] for x in out], pa.int32()), "steps": pa.array([x[2] for x in out], pa.list_(pa.int32()))})
    if held:
        yield pa.RecordBatch.from_pydict({"_e": [held[0][0]], "_slice": pa.array([held[0][1]], pa.int32()), "steps": pa.array([canonical(held[1])], pa.list_(pa.int32()))})


def _mine(parts: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    found: Counter[tuple[int, ...]] = Counter()
    block: Counter[tuple[int, ...]] = Counter()

    def work() -> None:
        used = sorted({x for s in block for x in s})
        code = {x: i for i, x in enumerate(used)}
        d = Diagram(Counter({tuple(code[x] for x in s): w for s, w in block.items()}), len(used))
        for p, w in d.mine(length):
            found[tuple(used[x] for x in p)] += w
        block.clear()

    n = 0
    for b in parts:
        for s in b.column(0).to_pylist():
            s = canonical([x for part in s for x in part])
            if s not in block:
                n += len(s)
            block[s] += 1
            if n >= BLOCK_STEPS:
                work()
                n = 0
    work()
    keys = list(found)
    for i in range(0, len(keys), 50_000):
        k = keys[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"p": pa.array(k, pa.list_(pa.int32())), "n": pa.array([found[x] for x in k], pa.int64())})


def frequent(
    df: DataFrame, entity: str, order_us: Column, tie: Column, event_id: Column, step: Column, length: int = 3, percent: int = 8, least: int = 6, limit: int = LIMIT
) -> DataFrame:
    """Rows (``steps`` array of ``length`` (at most 3) names, ``support``): patterns in at least ``percent`` % of the entities and in no fewer than ``least``."""
    if not 1 <= length <= 3:
        raise ValueError("the canonical form keeps patterns of up to three steps")
    scratch = Scratch(df.sparkSession, "patterns")
    ev = df.select(F.col(entity).cast("string").alias("_e"), order_us.alias("_s"), tie.alias("_tie"), F.coalesce(event_id, F.lit("")).alias("_id"), step.alias("_step")).filter(
        F.col("_e").isNotNull() & F.col("_s").isNotNull() & F.col("_step").isNotNull()
    )
    # A step that few entities hold is in no frequent pattern. Distinct pairs fold map-side; the steps that stay are few, as each
    # is held by a share of all entities.
    n = ev.select("_e").distinct().count()
    need = max(least, -(-percent * n // 100))
    common = ev.groupBy("_e", "_step").agg(F.lit(1).alias("x")).groupBy("_step").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need)
    common = scratch.keep(common.select("_step", (F.row_number().over(W.orderBy("_step")) - 1).cast("int").alias("_code")))
    small = common.count() <= SMALL_ALPHABET
    ev = ev.join(F.broadcast(common) if small else common, "_step").select("_e", "_s", "_tie", "_id", "_code")
    ev, cut = with_slices(ev, "_e", "_s", scratch, limit)
    short = ev.repartition("_e", "_slice").sortWithinPartitions("_e", "_slice", "_s", "_tie", "_id").select("_e", "_slice", "_s", "_id", "_code").mapInArrow(_shorten, "_e string, _slice int, steps array<int>")
    if cut:
        whole = short.groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("_slice", "steps"))).alias("a")).select(F.col("a.steps").alias("parts"))
    else:
        whole = short.select(F.array("steps").alias("parts"))
    counts = whole.mapInArrow(lambda parts: _mine(parts, length), "p array<int>, n bigint").groupBy("p").agg(F.sum("n").alias("support")).filter(F.col("support") >= need)
    names = counts
    for i in range(length):
        side = common.select(F.col("_step").alias(f"step_{i + 1}"), F.col("_code").alias(f"_c{i}"))
        names = names.withColumn(f"_c{i}", F.col("p")[i]).join(F.broadcast(side) if small else side, f"_c{i}").drop(f"_c{i}")
    return names.select(F.array(*[f"step_{i + 1}" for i in range(length)]).alias("steps"), "support")
