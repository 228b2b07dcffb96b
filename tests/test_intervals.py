import random

from spanwright.functions.instants import instant_us
from spanwright.operators.intervals import gaps, periods


def brute(rows):
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    out = {}
    for e, v in by.items():
        m = []
        for s, t in sorted(v):
            if m and s <= m[-1][1]:
                m[-1][1] = max(m[-1][1], t)
            else:
                m.append([s, t])
        out[e] = [tuple(x) for x in m]
    return out


def sample(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(500):
        s = r.choice([None] + [r.randrange(3000)] * 20)
        t = None if s is None or r.random() < 0.03 else s + r.choice([-3, 0, 1, 5, 5, 20])
        rows.append((r.choice(["a", "b", "hot", "hot", "hot", None]), s, t))
    return rows + [("point", 5, 5), ("touch", 1, 3), ("touch", 3, 4), ("same", 1, 2), ("same", 1, 2)]


def test_against_brute_force_with_and_without_slices(spark):
    rows = sample(3)
    want = brute(rows)
    df = spark.createDataFrame(rows, "e string, a long, b long").selectExpr("e", "a", "b", "e as _e", "1 as k", "2 as _slice")
    for limit in (100_000, 40):
        got = {}
        for r in periods(df, "e", "a", "b", limit).collect():
            got.setdefault(r["e"], []).append((r["period_start"], r["period_end"]))
        assert {k: sorted(v) for k, v in got.items()} == want
        g = sorted(map(tuple, gaps(df, "e", "a", "b", limit).collect()))
        assert g == sorted((e, x[1], y[0]) for e, v in want.items() for x, y in zip(v, v[1:]))


def test_empty(spark):
    df = spark.createDataFrame([], "e string, a long, b long")
    assert gaps(df, "e", "a", "b").count() == 0 and periods(df, "e", "a", "b").count() == 0


def test_instants(spark):
    t = ["2025-03-06T18:49:10.849467+02:00", "2025-03-06T16:49:10.849467Z", " 2025-03-06T16:49:10Z ", "2025-03-06 16:49:10.5", "", "x", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(instant_us(__import__("pyspark").sql.functions.col("t"))).collect()]
    base = 1741279750000000
    assert got == [base + 849467, base + 849467, base, base + 500000, None, None, None]
