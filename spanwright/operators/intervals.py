"""Continuous periods of overlapping intervals, and the gaps between them.

Starts and ends are ranked independently per entity. The i-th smallest end closes a period exactly if the start of rank i + 1 lies
beyond it (or there is none): then all of the i intervals begun have ended. So each end meets the start of the next rank, and where
start exceeds end there is a gap. The boundaries on both sides of gaps, in their order, pair to periods.

An end of several equal ones bears the last of their ranks, a start the first of theirs, so that one comparison a value suffices.
One shuffle by entity serves the ranks, the meeting and the pairing. Huge entities are cut along time into slices: ranks then go
on from the counts of earlier slices, one row a slice, and ends meet starts by a second shuffle on (entity, rank).

Defined results: rows with a null entity, a null bound, or an end not after its start don't count; equal
intervals count once in effect; periods that touch are one; an empty table gives no rows; columns of the
input other than the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.operators.slices import LIMIT, large_keys, running, with_slices
from spanwright.session import Scratch


def _met(df: DataFrame, entity: str, start: str, end: str, limit: int) -> tuple[DataFrame, bool]:
    """Rows (``_e``, ``_k``, ``_end``, ``_start``): of each rank ``_k`` the end that bears it and the start of the next, null where there is none. Also whether an entity was cut."""
    scratch = Scratch(df.sparkSession, "intervals")
    ok = df.select(F.col(entity).alias("_e"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_t")).filter(
        F.col("_e").isNotNull() & (F.col("_t") > F.col("_s"))
    )
    marks = ok.select("_e", F.explode(F.array(F.struct(F.col("_s").alias("t"), F.lit(True).alias("b")), F.struct(F.col("_t").alias("t"), F.lit(False).alias("b")))).alias("m")).select(
        "_e", F.col("m.t").alias("_t"), F.col("m.b").alias("_begins")
    )
    big = large_keys(marks, "_e", limit, scratch)
    marks, cut = with_slices(marks, "_e", "_t", scratch, limit, big)
    marks = scratch.keep(marks) if cut else marks.repartition("_e")
    w = W.partitionBy("_e", "_slice", "_begins").orderBy("_t") if cut else W.partitionBy("_e", "_begins").orderBy("_t")
    # Starts before this one; ends up to this one.
    ranked = marks.withColumn("_k", F.when(F.col("_begins"), F.rank().over(w) - 1).otherwise(F.count(F.lit(1)).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).cast("long"))
    if cut:
        before = W.partitionBy("_e", "_begins").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        totals = marks.groupBy("_e", "_slice", "_begins").agg(F.count(F.lit(1)).alias("_n"))
        totals = totals.select("_e", "_slice", "_begins", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        ranked = ranked.join(totals, ["_e", "_slice", "_begins"]).withColumn("_k", F.col("_k") + F.col("_base"))
    met = ranked.groupBy("_e", "_k").agg(F.max(F.when(~F.col("_begins"), F.col("_t"))).alias("_end"), F.max(F.when(F.col("_begins"), F.col("_t"))).alias("_start"))
    return met, cut


def gaps(df: DataFrame, entity: str, start: str, end: str, limit: int = LIMIT) -> DataFrame:
    """Rows (``entity``, ``gap_start``, ``gap_end``): between the end of a period and the start of the next. ``start`` and ``end`` are bigint columns."""
    met, _ = _met(df, entity, start, end, limit)
    return met.filter(F.col("_start") > F.col("_end")).select(F.col("_e").alias(entity), F.col("_end").alias("gap_start"), F.col("_start").alias("gap_end"))


def periods(df: DataFrame, entity: str, start: str, end: str, limit: int = LIMIT) -> DataFrame:
    """Rows (``entity``, ``period_start``, ``period_end``): the merged periods.

    A period lasts from the start behind a gap (or the first) to the end before the next gap (or the last).
    """
    met, cut = _met(df, entity, start, end, limit)
    opens = (F.col("_start") > F.col("_end")) | (F.col("_k") == 0)
    if not cut:
        met = met.withColumn("_last", F.max("_end").over(W.partitionBy("_e")))
        out = met.filter(opens).withColumn("_until", F.coalesce(F.lead("_end").over(W.partitionBy("_e").orderBy("_k")), "_last"))
        return out.select(F.col("_e").alias(entity), F.col("_start").alias("period_start"), F.col("_until").alias("period_end"))
    # Numbered openings and closings pair by number, an entity's gaps being as many as it may have. The last closing is the last end.
    scratch = Scratch(df.sparkSession, "periods")
    met = scratch.keep(met)
    edges = scratch.keep(running(met.filter(opens), "_e", "_k", {"_n": "1L"}, limit))
    last = edges.groupBy("_e").agg(F.max("_n").alias("_i")).join(met.groupBy("_e").agg(F.max("_end").alias("period_end")), "_e")
    closes = edges.filter("_k > 0").select("_e", (F.col("_n") - 1).alias("_i"), F.col("_end").alias("period_end")).unionByName(last)
    return edges.select("_e", F.col("_n").alias("_i"), F.col("_start").alias("period_start")).join(closes, ["_e", "_i"]).select(F.col("_e").alias(entity), "period_start", "period_end")
