import random

import numpy as np
from pyspark.sql import functions as F

from spanwright.llm import leakage, shared

WORDS = "amber bridge candle delta ember forest garden harbor island jungle kettle lantern meadow needle orchard pepper quarry river saddle timber umbrella valley window yellow zephyr anchor basket copper dragon engine falcon glacier hammer ivory jacket kernel ladder marble nickel oyster".split()


def sentence(r, n):
    return [r.choice(WORDS) + str(r.randrange(60)) if r.random() < 0.5 else r.choice(WORDS) for _ in range(n)]


def test_alike():
    assert leakage.alike("permit", "pemrit") and leakage.alike("seed", "seedd") and leakage.alike("pears", "pear")
    assert not leakage.alike("on", "upon") and not leakage.alike("entry", "order") and not leakage.alike("a", "b")


def test_words():
    assert leakage.words("<b>Red</b> _fox_, **Über**\nDay-7 &amp; x<y") == ["red", "fox", "über", "day", "7", "x", "y"]
    assert leakage.words(None) == leakage.words("  ") == []


def test_leaks(spark):
    r = random.Random(3)
    common = sentence(r, 20)
    items = {i: sentence(r, 50) for i in range(8)}
    items[8], items[9] = common + sentence(r, 40), common + sentence(r, 40)
    noise = lambda n: [w.upper() for w in sentence(r, n)]

    def edited(ws):
        ws = list(ws)
        for k in range(2, len(ws) - 1, 4):
            ws[k] = ws[k] + ws[k][-1] if k % 8 == 2 else "while"
        return ws

    docs = {
        1: noise(30) + items[0] + noise(30),
        2: noise(10) + items[1][10:30] + noise(5),
        3: noise(10) + items[2][10:24] + noise(5),  # too short
        4: noise(40) + edited(items[3]) + noise(3) + items[4][:19],
        5: noise(5) + common + noise(9),  # wording of several items
        6: items[8][15:45],
        7: noise(400),
        8: [], 9: ["<p>"] + [f"**{w.title()}**," for w in items[5]] + ["</p>"],
    }
    want = {(1, 0), (2, 1), (4, 3), (4, 4), (6, 8), (9, 5)}
    d = spark.createDataFrame([(k, " ".join(v), 1) for k, v in docs.items()] + [(10, None, 2), (1, " ".join(docs[1]), 7)], "doc_id long, text string, words int")
    b = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(99, None), (98, "short one")], "item_id long, text string")
    assert {tuple(x) for x in leakage.leaks(d, "doc_id", "text", b, "item_id", "text").collect()} == want
    old, leakage.BLOCK = leakage.BLOCK, 4
    try:
        assert {tuple(x) for x in leakage.leaks(d, "doc_id", "text", b, "item_id", "text").collect()} - want == set()
    finally:
        leakage.BLOCK = old
    assert leakage.leaks(d.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert leakage.leaks(d, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0


def longest(a, b):
    best, row = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, (new[j + 1], i, j))
        row = new
    return best[0]


def test_places_are_chosen_by_content():
    r = random.Random(1)
    f = shared.Fingerprints(50, 30)
    core = "".join(r.choice("ab \U0001f600é") for _ in range(50))
    for n in (0, 1, 49, 200):
        p, h = f.of("".join(r.choice("abc") for _ in range(n)) + core + "xyz" * n)
        mine = {int(x) for x, q in zip(h, p) if n <= q <= n + 20}
        assert mine & {int(x) for x in f.of(core)[1]}
    for unit in ("a", "ab", "abcdefg"):
        assert len(f.of(unit * 3000)[0]) == 4
    old, shared._CHUNK = shared._CHUNK, 97
    try:
        t = "".join(r.choice("abcd") for _ in range(1000))
        small = set(f.of(t)[0].tolist())
    finally:
        shared._CHUNK = old
    assert set(f.of(t)[0].tolist()) <= small


def test_pairs_and_coverage_against_brute_force(spark):
    r = random.Random(8)
    t = lambda n: "".join(r.choice("abcdefghij é\U0001f600") for _ in range(n))
    s60, s59, s200 = t(60), t(59), t(200)
    docs = [t(100) + s60, s60 + t(10), t(30) + s59 + t(40), s59 + t(80), s200, s200, t(7) + s200[20:150] + t(3), t(20), "", "z" * 300, "z" * 90, t(40) + s60 + t(5) + s200[100:180], "q" + s200, "ab" * 90, t(5) + "ba" * 35, "abc" * 20 + t(9), t(3) + "cab" * 40, "z" * 61]
    rows = [(i, x) for i, x in enumerate(docs)]
    df = spark.createDataFrame(rows + [(77, None), rows[0]], "doc_id long, text string").selectExpr("*", "'x' as _f", "0 as _d")
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if longest(docs[i], docs[j]) >= 60}
    for batches in (1, 4):
        s = shared.SharedStretches(df, "doc_id", "text", batches, 60, 40)
        assert {tuple(x) for x in s.pairs().collect()} == want
    cover = {x["_d"]: (x["n_chars"], x["n_shared"]) for x in s.coverage().collect()}
    for i, a in enumerate(docs):
        if len(a) < 60:
            assert i not in cover
            continue
        hit = np.zeros(len(a), bool)
        for j, b in enumerate(docs):
            if i != j:
                for k in range(len(a) - 59):
                    if a[k : k + 60] in b:
                        hit[k : k + 60] = True
        # inside stretches that repeat themselves only the alignments at their rims count
        periodic = i in (9, 10, 13, 14, 15, 16, 17)
        assert cover[i][0] == len(a) and (0 < cover[i][1] <= hit.sum() if periodic else cover[i][1] == hit.sum()), i
    assert shared.SharedStretches(df.limit(0), "doc_id", "text").pairs().count() == 0


def covered(docs, length):
    """Shared characters of each text, by all windows of all texts."""
    windows = [{x[k : k + length] for k in range(len(x) - length + 1)} for x in docs]
    out = []
    for i, x in enumerate(docs):
        hit = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if any(x[k : k + length] in w for j, w in enumerate(windows) if j != i):
                hit[k : k + length] = True
        out.append(int(hit.sum()))
    return windows, out


def test_coverage_of_stretches_that_repeat_themselves(spark):
    r = random.Random(12)
    t = lambda n: "".join(r.choice("abcdefgh \U0001f600") for _ in range(n))
    docs = [t(50) + "=" * 600 + t(40), t(9) + "=" * 900, "=" * 61 + t(30), t(20) + "log one." * 70 + t(5) + "log one." * 40, "g one.lo" * 60, t(4) + "one.log "[:7] * 8]
    for n in (1, 2, 7, 13, 17, 19, 20, 21, 23):
        unit, ends = t(n), [t(30) for _ in range(3)]
        for _ in range(7):  # of all phases and lengths, some with like surroundings
            k = r.randrange(n)
            body = (unit * 400)[k : k + r.choice((45, 55, 60, 61, 66, 75, 79, 80, 85, 120, 260))]
            docs.append(r.choice((t(30), t(5), "", ends[0])) + body + r.choice((t(30), "", ends[1], t(2) + (unit * 9)[:70])))
    docs = sorted(set(docs))
    windows, want = covered(docs, 60)
    s = shared.SharedStretches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "doc_id", "text", 2, 60, 40)
    assert {tuple(x) for x in s.pairs().collect()} == {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if windows[i] & windows[j]}
    got = {x["_d"]: x["n_shared"] for x in s.coverage().collect()}
    assert got == {i: want[i] for i, x in enumerate(docs) if len(x) >= 60}


def test_coverage_of_one_line_repeated(spark):
    rows = [(1, "head " + "=" * 3000), (2, "=" * 3000 + " tail"), (3, "x" + "a line of a log\n" * 200), (4, "a line of a log\n" * 40 + "y"), (5, "#" * 501), (6, "#" * 900)]
    s = shared.SharedStretches(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {x["_d"]: x["n_shared"] for x in s.coverage().collect()} == {1: 3000, 2: 3000, 3: 3200, 4: 640, 5: 501, 6: 900}


def test_spelling_finds_what_is_alike():
    r = random.Random(9)
    voc = sorted({"".join(r.choice("abcde") for _ in range(r.randrange(1, 12))) for _ in range(400)})
    s = leakage.Spelling(voc)
    for _ in range(300):
        w = "".join(r.choice("abcde") for _ in range(r.randrange(1, 13)))
        assert sorted(s.near(w)) == sorted(v for v in voc if leakage.alike(w, v))


def test_own_words_are_found_beside_shared_wording(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    shared, own, other = [word() for _ in range(30)], [word() for _ in range(20)], [word() for _ in range(20)]
    noise = lambda n: [word() for _ in range(n)]
    items = spark.createDataFrame([(1, " ".join(shared + own)), (2, " ".join(shared + other))], "item_id bigint, text string")
    docs = {
        1: own, 2: own + noise(3) + shared, 3: shared + noise(3) + own, 4: shared, 5: own[:17], 6: noise(900) + own + noise(500) + shared + noise(700) + other,
        7: ["<a href=" + "x" * 400 + ">"] + own[:10] + ["</a>"] + own[10:], 8: [],
    }
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id bigint, text string")
    got = sorted(map(tuple, leakage.leaks(df, "doc_id", "text", items, "item_id", "text").collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (6, 1), (6, 2), (7, 1)]


def test_items_of_one_template_have_seeds(spark):
    """Twenty items that share all their two- and three-word stretches, in different order, still have seeds."""
    r = random.Random(2)
    parts = [[f"w{i}a", f"w{i}b", f"w{i}c"] for i in range(12)]
    rows = [(k, " ".join(w for p in r.sample(parts, 12) for w in p)) for k in range(20)]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    ready = leakage.prepared(items, "item_id", "text").collect()
    assert len(ready) == 20 and min(len(x["seeds"]) for x in ready) >= 6
