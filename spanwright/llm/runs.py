"""Runs of equal consecutive events, each collapsed to one event with its count and duration.

Method: boundary interval lookup. The events of an entity chunk stand sorted; the places where the key changes are
gathered into a sorted array of run starts, each event finds its run by binary search in it, and the runs are
aggregated. A chunk is an (entity, slice): entities with more than ``limit`` events are cut along their order, and
the runs at the edges of slices, at most two a slice, are joined afterwards. Batches of a chunk stream through; only
the open run is carried.

Defined results: events with a null entity or null order don't count; several rows of one (entity, id) at one place are
one event; ties of the order are settled by ``tie`` (nulls first), then by id; keys compare as given, null like ''. An
event whose end is null or lies before its start ends when it starts. An empty table gives no rows; columns of the input
other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.operators.slices import LIMIT, with_slices
from spanwright.session import Scratch

_OUT = "_e string, _slice int, _key string, first_id string, last_id string, n_events bigint, start_us bigint, end_us bigint, _edge tinyint"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _same(c: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each row but the first equals the one before."""
    return pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)


def _runs(parts: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs of each chunk with at least ``least`` events. ``_edge``: 1 for the chunk's first run, 2 for its last, 3 for both."""
    held: dict | None = None  # the open run
    last = None

    def out(runs: list[dict]) -> Iterator[pa.RecordBatch]:
        if runs := [r for r in runs if r["n_events"] >= least]:
            yield pa.RecordBatch.from_pydict({k: [r[k] for r in runs] for k in _NAMES}, schema=_SCHEMA)

    for b in parts:
        t = pa.Table.from_batches([b]).combine_chunks()
        if not t.num_rows:
            continue
        e, sl, start, end, key, ids = (t.column(n).chunk(0) for n in ("_e", "_slice", "_s", "_t", "_key", "_id"))
        fresh = np.r_[True, ~(_same(e) & _same(ids) & _same(start))]
        fresh[0] = last != (e[0].as_py(), ids[0].as_py(), start[0].as_py())
        last = (e[-1].as_py(), ids[-1].as_py(), start[-1].as_py())
        if not fresh.all():
            keep = pa.array(fresh)
            e, sl, start, end, key, ids = (x.filter(keep) for x in (e, sl, start, end, key, ids))
            if not len(e):
                continue
        n = len(e)
        chunk_new = np.r_[True, ~(_same(e) & _same(sl))]
        starts = np.flatnonzero(chunk_new | np.r_[True, ~_same(key)])
        of = np.searchsorted(starts, np.arange(n), "right") - 1
        s = start.to_numpy()
        edge = chunk_new[starts].astype(np.int8)
        edge[:-1] += 2 * chunk_new[starts[1:]].astype(np.int8)
        tab = pa.RecordBatch.from_pydict(
            {
                "_e": e.take(pa.array(starts)),
                "_slice": sl.take(pa.array(starts)),
                "_key": key.take(pa.array(starts)),
                "first_id": ids.take(pa.array(starts)),
                "last_id": ids.take(pa.array(np.r_[starts[1:], n] - 1)),
                "n_events": pa.array(np.bincount(of, minlength=len(starts))),
                "start_us": pa.array(s[starts]),
                "end_us": pa.array(np.maximum.reduceat(np.maximum(end.to_numpy(), s), starts)),
                "_edge": pa.array(edge),
            },
            schema=_SCHEMA,
        )
        first = tab.slice(0, 1).to_pylist()[0]
        done = []
        if held and (held["_e"], held["_slice"]) != (first["_e"], first["_slice"]):
            done.append(held | {"_edge": held["_edge"] | 2})
        elif held and held["_key"] == first["_key"]:
            first |= {k: held[k] for k in ("first_id", "start_us")} | {"n_events": held["n_events"] + first["n_events"], "end_us": max(held["end_us"], first["end_us"]), "_edge": held["_edge"] | (first["_edge"] & 2)}
        elif held:
            done.append(held)
            first["_edge"] &= 2
        if len(starts) == 1:
            held = first
            yield from out(done)
            continue
        yield from out([*done, first])
        middle = tab.slice(1, len(starts) - 2)
        middle = middle.filter(pc.greater_equal(middle.column("n_events"), least))
        if middle.num_rows:
            yield middle
        held = tab.slice(len(starts) - 1, 1).to_pylist()[0]
    if held:
        yield from out([held | {"_edge": held["_edge"] | 2}])


_SCHEMA = pa.schema(
    [("_e", pa.string()), ("_slice", pa.int32()), ("_key", pa.string()), ("first_id", pa.string()), ("last_id", pa.string()), ("n_events", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("_edge", pa.int8())]
)


def collapse(df: DataFrame, entity: str, order_us: Column, tie: Column, event_id: Column, key: Column, end_us: Column, least: int = 2, limit: int = LIMIT) -> DataFrame:
    """Rows (``entity``, ``first_id``, ``last_id``, ``n_events``, ``start_us``, ``end_us``) of the runs with at least ``least`` events.

    ``order_us``, ``tie`` and ``end_us`` are bigint columns; ``key`` says which neighbours are alike.
    """
    scratch = Scratch(df.sparkSession, "runs")
    ev = df.select(
        F.col(entity).cast("string").alias("_e"),
        order_us.alias("_s"),
        tie.alias("_tie"),
        F.coalesce(event_id, F.lit("")).alias("_id"),
        F.coalesce(key, F.lit("")).alias("_key"),
        F.coalesce(end_us, order_us).alias("_t"),
    ).filter(F.col("_e").isNotNull() & F.col("_s").isNotNull())
    ev, cut = with_slices(ev, "_e", "_s", scratch, limit)
    ordered = ev.repartition("_e", "_slice").sortWithinPartitions("_e", "_slice", "_s", "_tie", "_id")
    ask = 1 if cut else least
    runs = ordered.select("_e", "_slice", "_s", "_t", "_key", "_id").mapInArrow(lambda parts: _runs(parts, ask), _OUT)
    cols = [F.col("_e").alias(entity), "first_id", "last_id", "n_events", "start_us", "end_us"]
    if not cut:
        return runs.select(*cols)
    runs = scratch.keep(runs.filter((F.col("_edge") > 0) | (F.col("n_events") >= least)))
    edges = runs.filter("_edge > 0").withColumn("_at", F.col("_slice") * 2 + F.when(F.col("_edge") == 2, 1).otherwise(0))
    order = W.partitionBy("_e").orderBy("_at")
    edges = edges.withColumn("_new", F.when(F.lag("_key").over(order).eqNullSafe(F.col("_key")) & ((F.col("_edge") != 2) | (F.lag("_edge").over(order) == 3)), 0).otherwise(1))
    edges = edges.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = (
        edges.groupBy("_e", "_run")
        .agg(F.min_by("first_id", "_at").alias("first_id"), F.max_by("last_id", "_at").alias("last_id"), F.sum("n_events").alias("n_events"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
        .filter(F.col("n_events") >= least)
    )
    return runs.filter("_edge = 0").select(*cols).unionByName(joined.select(*cols))
