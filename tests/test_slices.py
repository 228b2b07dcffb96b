from pyspark.sql import functions as F

from spanwright.operators.slices import hashed_sample, running, running_over_all, spread_join
from spanwright.session import Scratch
from spanwright.operators import slices


def test_sample_holds_distinct_values_whatever_their_repetition(spark):
    for distinct in (50, 500, 5_000):
        df = spark.range(60_000).select(F.concat(F.lit("text "), (F.col("id") % distinct).cast("string")).alias("t"), F.col("id").alias("other"))
        got = [r["t"] for r in hashed_sample(df, "t", 2_000)]
        assert len(got) == len(set(got)) == min(2_000, distinct)
        assert got == [r["t"] for r in hashed_sample(df.repartition(7), "t", 2_000)]
    assert hashed_sample(df.limit(0), "t", 5) == [] and hashed_sample(df, "t", 0) == []
    some = hashed_sample(df, "t", 2_000, most_bytes=1_000)
    assert 90 < len(some) < 120 and sum(len(r["t"]) for r in some) <= 1_000
    assert hashed_sample(spark.createDataFrame([(None, 1), ("a", 2), ("a", 1)], "t string, n int"), "t", 9)[0].asDict() == {"t": "a", "n": 1}


def test_slices_of_keys_of_different_sizes(spark, monkeypatch):
    rows = [("big", i, i % 3) for i in range(3_000)] + [("mid", i, 1) for i in range(90)] + [("one", 5, 7)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    want = {}
    total = {}
    for k, o, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        want[k, o] = total[k]
    for cuts in (2_000_000, 1):  # bounds broadcast, and copied for parts of the keys
        monkeypatch.setattr(slices, "BROADCAST_CUTS", cuts)
        got = running(df, "k", "o", {"s": "v"}, limit=20)
        assert {(r["k"], r["o"]): r["s"] for r in got.collect()} == want
    cut, any_ = slices.with_slices(df, "k", "o", Scratch(spark, "t"), 20)
    sizes = {(r["k"], r["_slice"]): r["count"] for r in cut.groupBy("k", "_slice").count().collect()}
    assert any_ and max(sizes.values()) < 60 and len([k for k, _ in sizes if k == "big"]) > 100 and len([k for k, _ in sizes if k == "mid"]) == 5
    least = running(df.withColumn("o", -F.col("o")), "k", "o", {"s": "case when v = 0 then -o end"}, limit=20, how="min").filter("k = 'big'")
    assert all(r["s"] == min((x for x in range(-r["o"], 3_000) if x % 3 == 0), default=None) for r in least.collect())


def test_running_over_all_and_spread_join(spark):
    df = spark.range(500).select((F.col("id") / 7).alias("p"), F.lit(1).alias("one")).repartition(6)
    got = {r["p"]: r["n"] for r in running_over_all(df, "p", {"n": "one"}, descending=True).collect()}
    assert got == {i / 7: 500 - i for i in range(500)}
    left = spark.range(300).select(F.when(F.col("id") < 250, "hot").otherwise("cold").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("other", 2)], "k string, v int")
    big = spark.createDataFrame([("hot",)], "k string")
    for b in (None, big):
        rows = spread_join(left, right, ["k"], "k", b).collect()
        assert len(rows) == 300 and all(r["v"] == (1 if r["k"] == "hot" else None) for r in rows)
