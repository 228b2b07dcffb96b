import random

from spanwright.operators.hierarchy import hierarchy, members_below


def brute(rows):
    par = {}
    for s, i, p in rows:
        if s is None or i is None:
            continue
        old = par.get((s, i))
        par[(s, i)] = p if old is None else old if p is None else min(old, p)
    out = {}
    for s, i in par:
        seen, cur = [], i
        while True:
            if cur in seen:
                cyc = seen[seen.index(cur):]
                out[(s, i)] = (min(cyc), -1 if i in cyc else -2, None)
                break
            seen.append(cur)
            p = par[(s, cur)]
            if p is None or (s, p) not in par:
                out[(s, i)] = (cur, len(seen) - 1, seen[::-1])
                break
            cur = p
    return out


def sample(seed, n=300):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        s = r.choice(["a", "b", "hot", "hot", None if r.random() < 0.02 else "c"])
        i = f"n{r.randrange(n // 3)}"
        p = r.choice([None, "", "missing", i] + [f"n{r.randrange(n // 3)}"] * 12)
        rows.append((s, i, p))
    rows += [("chain", f"c{k:03d}", f"c{k - 1:03d}" if k else None) for k in range(130)]
    rows += [("ring", f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [("ring", "tail", "r3"), ("ring", "tail2", "tail"), ("ring", "", None), ("ring", "kid", "")]
    return rows


def run(spark, rows, limit):
    df = spark.createDataFrame(rows, "s string, i string, p string").selectExpr("s", "i", "p", "'x' as node_id", "1 as depth", "s as scope", "i as id")
    h = hierarchy(df, "s", "i", "p", with_path=True, limit=limit)
    return h, {(r["s"], r["node_id"]): r for r in h.collect()}


def test_against_brute_force_both_ways(spark):
    rows = sample(1)
    want = brute(rows)
    got = {}
    for limit in (10_000, 20):
        h, got[limit] = run(spark, rows, limit)
        assert {k: (r["root_id"], r["depth"], r["path"]) for k, r in got[limit].items()} == want
        for (s, i), r in got[limit].items():
            if r["depth"] >= 0:
                below = {j for (t, j), q in got[limit].items() if t == s and q["lft"] is not None and r["lft"] < q["lft"] <= r["rgt"]}
                assert below == {j for (t, j), q in got[limit].items() if t == s and q["path"] and i in q["path"][:-1]}
                assert r["subtree_size"] == len(below) + 1
    assert got[20] == got[10_000]


def test_members_below(spark):
    h, got = run(spark, sample(2), 10_000)
    asked = h.filter("depth between 0 and 2").select("s", "node_id")
    pairs = {(r["s"], r["ancestor_id"], r["node_id"], r["distance"]) for r in members_below(h, "s", asked).collect()}
    want = {
        (s, a, i, len(r["path"]) - 1 - r["path"].index(a)) for (s, i), r in got.items() if r["path"] for a in r["path"][:-1] if got[(s, a)]["depth"] <= 2
    }
    assert pairs == want


def test_empty(spark):
    h, got = run(spark, [("a", "b", "c")], 10)
    assert len(got) == 1
    df = spark.createDataFrame([], "s string, i string, p string")
    assert hierarchy(df, "s", "i", "p").count() == 0
