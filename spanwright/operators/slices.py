"""Splitting of ordered groups that are too large for one task.

A key with more than ``limit`` rows is cut along its order into slices of about ``limit`` rows. The
boundaries come from quantile sketches of those keys alone, which combine map-side; the other keys keep the
single slice 0 and need no second look.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from spanwright.session import Scratch

LIMIT = 200_000
MOST_SLICES = 16_384  # of one key; a key with more than LIMIT times as many rows gets larger slices
BROADCAST_CUTS = 2_000_000
SALTS = 64
_STEP = 64


def large_keys(df: DataFrame, key: str, limit: int, scratch: Scratch) -> DataFrame | None:
    """The keys with more than ``limit`` rows and their counts, as a written table; None if there are none."""
    big = scratch.keep(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit))
    if big.isEmpty():
        scratch.drop(big)
        return None
    return big


def _cuts(df: DataFrame, key: str, order: str, big: DataFrame, limit: int) -> DataFrame:
    """(``key``, ``_cuts``): the boundaries of each large key's own number of slices. Keys of like size (within a factor of 16) share a sketch size."""
    sized = big.withColumn("_m", F.least(F.ceil(F.col("_n") / limit), F.lit(MOST_SLICES)).cast("int"))
    out, low = None, 1
    while low < MOST_SLICES:
        high = min(low * 16, MOST_SLICES)
        some = sized.filter((F.col("_m") > low) & (F.col("_m") <= high))
        m = some.agg(F.max("_m")).first()[0]
        if m:
            q = F.percentile_approx(order, [i / m for i in range(1, m)], 10 * m)
            rows = df.join(F.broadcast(some.select(key, "_m")) if some.count() <= BROADCAST_CUTS // m else some.select(key, "_m"), key)
            own = F.transform(F.sequence(F.lit(1), F.col("_m") - 1), lambda i: F.col("_q")[(F.floor(i * F.lit(m) / F.col("_m")) - 1).cast("int")])
            part = rows.groupBy(key, "_m").agg(q.alias("_q")).select(key, F.array_distinct(own).alias("_cuts"))
            out = part if out is None else out.unionByName(part)
        low = high
    return out


def with_slices(df: DataFrame, key: str, order: str, scratch: Scratch, limit: int = LIMIT, big: DataFrame | None | bool = True) -> tuple[DataFrame, bool]:
    """Adds ``_slice`` (int): rows of a key are ordered by (``_slice``, ``order``). Returns also whether any key was cut.

    ``order`` is a bigint column. Rows of one key with the same ``order`` value share a slice. ``big``: the large keys (``key``, ``_n``) or None if
    there are none, where that is known already. The bounds, one a slice of a large key, are broadcast up to ``BROADCAST_CUTS`` of them; beyond
    that they are copied for each of ``SALTS`` parts of a key's rows, so that no large key meets them in one task.
    """
    big = large_keys(df, key, limit, scratch) if big is True else big
    if big is None:
        return df.withColumn("_slice", F.lit(0)), False
    bounds = _cuts(df, key, order, big, limit)
    if bounds is None:
        return df.withColumn("_slice", F.lit(0)), False
    heads = F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / _STEP).cast("int")), lambda i: F.col("_cuts")[i * _STEP])
    bounds = scratch.keep(bounds.withColumn("_heads", heads))
    x = F.col(order)
    # Two looks: among every 64th bound, then among the bounds behind that one.
    group = F.size(F.filter("_heads", lambda b: b < x))
    inner = F.when(group == 0, 0).otherwise((group - 1) * _STEP + F.size(F.filter(F.slice("_cuts", (group - 1) * _STEP + 1, F.lit(_STEP)), lambda b: b < x)))
    cut = F.when(F.col("_cuts").isNull(), 0).otherwise(inner).cast("int")
    if bounds.agg(F.sum(F.size("_cuts"))).first()[0] <= BROADCAST_CUTS:
        joined = df.join(F.broadcast(bounds), key, "left")
    else:
        spread = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"], "left").drop("_salt")
    return joined.withColumn("_slice", cut).drop("_cuts", "_heads"), True


_COMBINE = {"sum": (F.sum, lambda a, b: a + b, 0), "min": (F.min, F.least, None), "max": (F.max, F.greatest, None)}


def running(df: DataFrame, key: str, order: str, sums: dict[str, str], limit: int = LIMIT, how: str = "sum", big: DataFrame | None | bool = True) -> DataFrame:
    """Adds running sums (``how``: or ``min``, ``max``) over the rows of each ``key`` in the order of the bigint column ``order``, the row's own value included.

    ``sums``: new column to SQL expression. Rows with equal order get equal sums. Huge keys are cut into slices; the sums of
    earlier slices come from one row a slice.
    """
    from pyspark.sql import Window as W

    agg, both, none = _COMBINE[how]
    scratch = Scratch(df.sparkSession, "running")
    rows, cut = with_slices(df, key, order, scratch, limit, big)
    if cut:
        rows = scratch.keep(rows)
    w = W.partitionBy(key, "_slice").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumns({c: agg(F.expr(e)).over(w) for c, e in sums.items()})
    if cut:
        before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        totals = rows.groupBy(key, "_slice").agg(*[agg(F.expr(e)).alias(f"_t_{c}") for c, e in sums.items()])
        base = lambda c: agg(f"_t_{c}").over(before) if none is None else F.coalesce(agg(f"_t_{c}").over(before), F.lit(none))
        totals = totals.select(key, "_slice", *[base(c).alias(f"_b_{c}") for c in sums])
        out = out.join(totals, [key, "_slice"]).withColumns({c: both(F.col(c), F.col(f"_b_{c}")) for c in sums}).drop(*[f"_b_{c}" for c in sums])
    return out.drop("_slice")


def running_over_all(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds running sums over all rows by ``order`` (any sortable type; distinct values). Rows are split by ranges of the order; each range starts
    from the sums of the ranges before it, one row a range."""
    from pyspark.sql import Window as W

    by = F.desc(order) if descending else F.asc(order)
    kept = Scratch(df.sparkSession, "ranges").keep(df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))
    totals = kept.groupBy("_p").agg(*[F.sum(F.expr(e)).alias(f"_t_{c}") for c, e in sums.items()])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_p", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    w = W.partitionBy("_p").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = kept.withColumns({c: F.sum(F.expr(e)).over(w) for c, e in sums.items()})
    return out.join(F.broadcast(totals), "_p").withColumns({c: F.col(c) + F.col(f"_b_{c}") for c in sums}).drop("_p", *[f"_b_{c}" for c in sums])


def spread_join(left: DataFrame, right: DataFrame, on: list[str], key: str, big: DataFrame | None, how: str = "left", salts: int = SALTS) -> DataFrame:
    """A join whose right side has one row a key (or few), where single values of ``key`` (one of ``on``) hold very many left rows.

    The left rows of a key in ``big`` (``key``) are dealt to ``salts`` parts and the right rows of such a key are copied to each; other keys join as usual.
    Columns of any type may stand in the left rows: what holds a map is dealt by its JSON text, as maps have no hash.
    """
    if big is None:
        return left.join(right, on, how)
    names = big.select(F.col(key), F.lit(True).alias("_hot"))
    n = names.count()
    names = F.broadcast(names) if n <= BROADCAST_CUTS // 4 else names
    rest = [F.to_json(F.struct(c.name)) if "map<" in c.dataType.simpleString() else F.col(c.name) for c in left.schema if c.name not in on]
    left = left.join(names, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(names, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hashed_sample(df: DataFrame, hashed: str, n: int, most_bytes: int | None = None) -> list:
    """Rows with ``min(n, distinct)`` distinct values of the column ``hashed``, those with the least hashes, one row each (the least of them), in the order of the hashes.

    The cut of the hashes is sized by an approximate count of distinct values and widened until it holds enough, so that repetition
    doesn't matter and what reaches the driver is near ``n`` rows. ``most_bytes`` bounds the sum of the values' bytes: whole values are
    taken in the order of their hashes, those that would pass the bound are left out.
    """
    df = df.filter(F.col(hashed).isNotNull())
    space = 1 << 62
    h = F.pmod(F.xxhash64(F.col(hashed)), F.lit(space))
    distinct = df.agg(F.approx_count_distinct(hashed, 0.02)).first()[0]
    if not distinct or n <= 0:
        return []
    share = min(1.0, 2.0 * n / distinct)
    while True:
        part = (df if share >= 1 else df.filter(h < F.lit(int(space * share)))).withColumn("_h", h)
        heads = part.select("_h", F.octet_length(F.col(hashed).cast("string")).alias("_b") if most_bytes else F.lit(0).alias("_b")).distinct().orderBy("_h").limit(n).collect()
        if share >= 1 or len(heads) >= n:
            break
        share = min(1.0, share * 4)
    wanted, used = [], 0
    for r in heads:
        if most_bytes is None or used + r["_b"] <= most_bytes:
            wanted.append(r["_h"])
            used += r["_b"]
    if not wanted:
        return []
    keep = set(wanted)
    longest = max(r["_b"] for r in heads if r["_h"] in keep) if most_bytes else None
    part = part.filter(F.col("_h") <= F.lit(max(wanted)))
    if most_bytes:
        part = part.filter(F.octet_length(F.col(hashed).cast("string")) <= longest)
    others = [c for c in df.columns if c != hashed]
    if others:
        one = part.groupBy("_h", hashed).agg(F.min(F.struct(*others)).alias("_o"))
    else:
        one = part.select("_h", hashed).distinct().withColumn("_o", F.struct())
    rows = [r for r in one.orderBy("_h", hashed).collect() if r["_h"] in keep][:n]
    return [Row(**{c: r[hashed] if c == hashed else r["_o"][c] for c in df.columns}) for r in rows]
