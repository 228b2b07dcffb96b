import random
from collections import Counter
from itertools import combinations, groupby

from pyspark.sql import functions as F

from spanwright.llm.patterns import canonical, frequent
from spanwright.llm.runs import collapse
from spanwright.llm.steps import error_key, step_of, tool_key


def events(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        e = r.choice(["a", "b", "hot", "hot", "hot", None])
        s = r.choice([None] + [r.randrange(60)] * 15)
        rows.append((e, s, i, f"id{i}", r.choice("xxxyyz"), None if r.random() < 0.2 else (s or 0) + r.randrange(-3, 9)))
    return rows + r.sample(rows, 40)


def ordered(rows):
    rows = sorted({x for x in rows if x[0] is not None and x[1] is not None})
    return {e: list(v) for e, v in groupby(sorted(rows, key=lambda x: (x[0], x[1], x[2])), key=lambda x: x[0])}


def frame(spark, rows):
    return spark.createDataFrame(rows, "e string, s long, pos long, id string, k string, t long").selectExpr("*", "1 as _slice", "'q' as first_id", "2 as _edge", "0 as n_events")


def test_runs_with_and_without_slices(spark):
    rows = events(1)
    want = []
    for e, v in ordered(rows).items():
        for _, g in groupby(v, key=lambda x: x[4]):
            g = list(g)
            want.append((e, g[0][3], g[-1][3], len(g), g[0][1], max(max(x[1], x[5] if x[5] is not None else x[1]) for x in g)))
    df = frame(spark, rows)
    for limit in (10_000, 25):
        for least in (1, 2):
            got = collapse(df, "e", F.col("s"), F.col("pos"), F.col("id"), F.col("k"), F.col("t"), least, limit)
            assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[3] >= least)


def test_runs_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_runs_with_and_without_slices(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_canonical_keeps_patterns():
    r = random.Random(4)
    for _ in range(300):
        s = [r.randrange(4) for _ in range(r.randrange(1, 25))]
        c = canonical(s)
        assert len(c) <= len(s)
        for k in (1, 2, 3):
            assert {*combinations(s, k)} == {*combinations(c, k)}


def test_patterns_with_and_without_slices(spark):
    rows = events(2, 200)
    # four more entities, so that shares differ
    rows += [(f"e{j}", i, i, f"m{i}", k, None) for j, seq in enumerate(["xyz", "zyx", "xxyy", "y"]) for i, k in enumerate(seq)]
    by = {e: [x[4] for x in v] for e, v in ordered(rows).items()}
    n = Counter(p for s in by.values() for p in {*combinations(s, 3)})
    want = {(p, w) for p, w in n.items() if w >= 3 and w * 100 >= 45 * len(by)}
    assert want
    for limit in (10_000, 15):
        got = frequent(frame(spark, rows), "e", F.col("s"), F.col("pos"), F.col("id"), F.col("k"), percent=45, least=3, limit=limit)
        assert {(tuple(r["steps"]), r["support"]) for r in got.collect()} == want


def test_empty(spark):
    df = frame(spark, [])
    assert collapse(df, "e", F.col("s"), F.col("pos"), F.col("id"), F.col("k"), F.col("t")).count() == 0
    assert frequent(df, "e", F.col("s"), F.col("pos"), F.col("id"), F.col("k")).count() == 0


def test_keys(spark):
    rows = [("findParcel", " Row version 77 is stale. "), ("find_parcel ", "ROW  version 9 is\tstale"), ("Find-Parcel", None), ("x", " "), ("x", "404"), ("", "")]
    df = spark.createDataFrame(rows, "n string, e string")
    got = df.select(tool_key(F.col("n")), error_key(F.col("e"))).collect()
    assert [r[0] for r in got] == ["findparcel"] * 3 + ["x", "x", ""]
    assert [r[1] for r in got] == ["!rowversionisstale"] * 2 + ["", "", "!", ""]
    k = spark.createDataFrame([("other", " Plan ", {"openinference.span.kind": "Chain"}), ("OTHER", None, {}), ("tool", "a", None)], "k string, n string, a map<string,string>")
    assert [r[0] for r in k.select(step_of(F.col("k"), F.col("n"), F.col("a"))).collect()] == ["chain/plan", "other/", "tool/a"]
