import datetime as dt
import random

from pyspark.sql import functions as F

from spanwright.llm.consensus import Consensus, on_scale, usable

SCALE = ["resolved", "partly_resolved", "unresolved", "harmful"]


def test_usable_labels(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [
        ("i", "a", " Partly-Resolved ", t), ("i", "a", "harmful", t - dt.timedelta(1)), ("i", "a", "?", t + dt.timedelta(1)), ("i", "a", " Partly-Resolved ", t),
        ("i", "b", "RESOLVED", None), ("i", "c", "partly resolved", t), ("i", "d", None, t), (None, "a", "resolved", t), ("i", None, "resolved", t),
        ("j", "a", "resolved", t), ("j", "b", "resolved", t),
    ]
    df = spark.createDataFrame(rows, "item string, who string, label string, at timestamp").selectExpr("*", "1 as _i", "2 as _w")
    got = usable(df, "item", "who", on_scale(F.col("label"), SCALE), "at", 3)
    assert sorted(map(tuple, got.collect())) == [("i", "a", "partly_resolved"), ("i", "b", "resolved"), ("i", "c", "partly_resolved")]
    c = Consensus(got)
    r = c.items.first()
    assert (r["label"], r["n_annotators"], round(r["agreement"], 4)) == ("partly_resolved", 3, 0.3333)


def test_recovers_labels_that_the_majority_misses(spark):
    r = random.Random(5)
    good, bad = [f"g{i}" for i in range(6)], [f"b{i}" for i in range(8)]
    truth, rows = {}, []
    for i in range(250):
        truth[f"i{i}"] = t = r.choice(SCALE)
        for a in r.sample(good, 2) + r.sample(bad, 3):
            ok = r.random() < (0.96 if a[0] == "g" else 0.3)
            rows.append((f"i{i}", a, t if ok else r.choice(SCALE)))
    votes = spark.createDataFrame(rows, "_i string, _a string, _l string")
    c = Consensus(votes)
    got = {x["_i"]: x["label"] for x in c.items.collect()}
    right = sum(got[i] == t for i, t in truth.items()) / len(truth)
    assert right > 0.93
    assert c.converged and c.rounds < 30
    joined = Consensus(votes, annotators_limit=0)
    assert sorted(map(tuple, joined.items.select("_i", "label", "n_annotators").collect())) == sorted(map(tuple, c.items.select("_i", "label", "n_annotators").collect()))
    w = {x["_a"]: x["weight"] for x in c.annotators.collect()}
    assert min(w[a] for a in good) > 2 * max(w[a] for a in bad)


def test_empty(spark):
    c = Consensus(spark.createDataFrame([], "_i string, _a string, _l string"))
    assert c.items.count() == 0 and c.annotators.count() == 0
