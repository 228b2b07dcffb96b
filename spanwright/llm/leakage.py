"""Passages of held-out test items in a corpus, whole, in part or slightly changed.

Method: rare n-gram seeds (two and three words that stand in at most ``SEED_ITEMS`` items, and of each ``SEED_WORDS`` places of an item around which these are few
the rarest whatever its number, so that every passage has seeds however many items there are) join corpus passages to test items;
Smith-Waterman alignments of words, with an inexact credit for misspelt ones, then score each pair of passage and item. An
item leaked if an alignment has a stretch of at least ``least`` of its words of which at most ``changed`` (a share) differ.
Words inside runs of ``SHARED`` words or more that stand in several items don't count and score nothing in the alignment. After an alignment
its place in the text is masked and the next best is taken, as long as one could hold such a stretch. Long passages are aligned in
overlapping windows of four times the item's length. Where the passages of several items
overlap, the one with most equal words is kept; of several with equally many none, as the wording then is that of several.

The items are the stated query set: they are taken in blocks of ``BLOCK`` items, each sent to all tasks, and every block meets
every document in one pass without a shuffle.

Defined results: letter case, punctuation, white space and mark-up (tags, underscores, asterisks) don't matter; null and empty
texts match nothing; items with fewer than ``least`` words can't be found; rows of one doc or item id count each and results are
distinct; texts of any length are read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.session import Scratch

SEED_ITEMS = 3
SEED_WORDS = 6
SHARED = 12
BLOCK = 20_000
REACH = 24
KEPT_WORDS = 200_000
LONGEST = 40

_MARK = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]{2,6};|_")
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text or "&" in text or "_" in text:
        text = _MARK.sub(" ", text)
    return _WORD.findall(text.lower())


def alike(a: str, b: str) -> bool:
    """Misspelt: one edit or swap of neighbours apart (two for words of eight letters or more); words beyond ``LONGEST`` letters only if equal."""
    n, m = len(a), len(b)
    most = 2 if max(n, m) >= 8 else 1
    if abs(n - m) > most or min(n, m) < 2 or max(n, m) > LONGEST:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    return max(len(a), len(b)) <= most or (len(a) == len(b) == 2 and a == b[::-1])


def _shorter(word: str) -> set[str]:
    """A word and what is left of it without one letter (two, if its misspellings may be two edits apart)."""
    out = {word}
    for _ in range(2 if len(word) >= 6 else 1):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


class Spelling:
    """Which words of a vocabulary a word may be a misspelling of. Words that are alike share a shortened form."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.forms: dict[str, list[str]] = {}
        for w in vocabulary:
            for f in _shorter(w):
                self.forms.setdefault(f, []).append(w)
        self.known: dict[str, list[str]] = {}

    def near(self, word: str) -> list[str]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > KEPT_WORDS:
                self.known = {}
            # words beyond any in the vocabulary by more than two letters have no shortened form there
            some = {v for f in _shorter(word) for v in self.forms.get(f, ())} if len(word) <= LONGEST else set()
            got = self.known[word] = [v for v in some if alike(word, v)]
        return got


class Item:
    def __init__(self, item_id: object, text_words: list[str], counts: list[bool]) -> None:
        self.id, self.words, self.counts = item_id, text_words, np.array(counts, bool)
        self.codes = np.zeros(0, np.int64)  # the block's numbers of the words


def _scores(item: Item, b: list[str], spelling: Spelling) -> np.ndarray:
    """Of each word of the item with each of a passage: 2 if equal, 1 if alike, else -1; 0 instead of 2 and 1 where the item's word doesn't count."""
    a = item.words
    code = {w: i for i, w in enumerate(dict.fromkeys(a))}
    ca, cb = np.array([code[w] for w in a]), np.array([code.get(w, -1) for w in b])
    score = np.where(ca[:, None] == cb[None, :], 2.0, -1.0)
    near: dict[str, list[int]] = {}
    for j in np.flatnonzero(cb < 0):
        w = b[j]
        if w not in near:
            near[w] = [i for x in spelling.near(w) if x in code for i in np.flatnonzero(ca == code[x])]
        for i in near[w]:
            score[i, j] = 1.0
    return np.where(item.counts[:, None], score, np.minimum(score, 0.0))


def alignments(item: Item, doc: list[str], codes: np.ndarray, lo: int, hi: int, spelling: Spelling, least: float, equal: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Smith-Waterman of the item with words lo..hi of a document, the best first, each masked for the next, while they score ``least`` and at least ``equal`` of the item's words that count stand in what isn't masked. Per item word: its place in the document or -1, and 2 if
    equal, 1 if alike, 0 else."""
    free, own = codes[lo:hi].copy(), item.codes[item.counts]
    if np.isin(own, free).sum() < equal:
        return
    score = _scores(item, doc[lo:hi], spelling)
    n, m = score.shape
    gap = 1.0
    ramp = gap * np.arange(m + 1)
    while True:
        h = np.zeros((n + 1, m + 1))
        for i in range(n):
            np.maximum(h[i, :-1] + score[i], h[i, 1:] - gap, out=h[i + 1, 1:])
            # Gaps along the row: the best of all places before, less their distance; 0 at least, as place 0 is 0.
            h[i + 1] = np.maximum(np.maximum.accumulate(h[i + 1] + ramp) - ramp, 0)
        i, j = np.unravel_index(h.argmax(), h.shape)
        if h[i, j] < least:
            return
        place, how, last = np.full(n, -1), np.zeros(n, np.int8), j
        while i > 0 and j > 0 and h[i, j] > 0:
            if h[i, j] == h[i - 1, j - 1] + score[i - 1, j - 1]:
                i, j = i - 1, j - 1
                place[i] = lo + j
                how[i] = 2 if score[i, j] == 2 else 1 if score[i, j] == 1 else 0
            elif h[i, j] == h[i - 1, j] - gap:
                i -= 1
            else:
                j -= 1
        yield place, how
        score[:, j:last] = -1e9
        free[j:last] = -1
        if np.isin(own, free).sum() < equal:
            return


def stretch(item: Item, place: np.ndarray, how: np.ndarray, least: int, changed: float) -> tuple[int, int, int] | None:
    """(equal words, first, last place in the document) of the stretch of the item that shows the leak best, if there is one."""
    at = np.flatnonzero(place >= 0)
    if not at.size:
        return None
    i0, i1 = at[0], at[-1] + 1
    counts = item.counts[i0:i1]
    c = np.r_[0, np.cumsum(counts)]
    eq = np.r_[0, np.cumsum((how[i0:i1] == 2) & counts)]
    best = None
    n = len(counts)
    # A stretch qualifies if equal - (1 - changed) * counted >= 0: for each end the start with the least prefix value.
    value = eq - (1 - changed) * c
    for j in range(n, 0, -1):
        starts = np.flatnonzero((c[j] - c[:j] >= least) & (value[j] - value[:j] >= -1e-9))
        if starts.size:
            got = int(eq[j] - eq[starts[0]])
            if best is None or got > best[0]:
                p = place[i0 + starts[0] : i0 + j]
                p = p[p >= 0]
                best = (got, int(p[0]), int(p[-1]))
    return best


class Block:
    """The items of a block and their seeds."""

    def __init__(self, rows: list[tuple]) -> None:
        self.items = [Item(i, w, c) for i, w, c, _ in rows]
        self.code = {w: k for k, w in enumerate(dict.fromkeys(w for x in self.items for w in x.words))}
        self.size = len(self.code) + 1
        for x in self.items:
            x.codes = np.array([self.code[w] for w in x.words], np.int64)
        self.spelling = Spelling(list(self.code))
        pairs = []
        for k, (_, w, _, seeds) in enumerate(rows):
            for s in seeds:
                v = s.split(" ")
                pairs.append((self._key([self.code[x] for x in v]), k))
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.of = np.array([p[1] for p in pairs], np.int64)

    def _key(self, v: list[int]) -> int:
        return (v[0] + 1) * self.size + v[1] + 1 if len(v) == 2 else ((v[0] + 1) * self.size + v[1] + 1) * self.size + v[2] + 1

    def codes(self, doc: list[str]) -> np.ndarray:
        """The numbers of a document's words among those of the items, -1 for others."""
        get = self.code.get
        return np.fromiter((get(x, -1) for x in doc), np.int64, len(doc))

    def seeds(self, codes: np.ndarray) -> dict[int, list[int]]:
        """Places of seeds in a document by item."""
        w = codes + 1
        if len(w) < 2 or not len(self.keys):
            return {}
        two = np.where((w[:-1] > 0) & (w[1:] > 0), w[:-1] * self.size + w[1:], -1)
        three = np.where((two[:-1] > 0) & (w[2:] > 0), two[:-1] * self.size + w[2:], -1)
        out: dict[int, list[int]] = {}
        for key in (two, three):
            at = np.flatnonzero(key > 0)
            lo, hi = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
            for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
                for k in self.of[a:b]:
                    out.setdefault(int(k), []).append(int(p))
        return out

    def find(self, doc: list[str], least: int, changed: float) -> list[object]:
        found: list[tuple[int, int, int, object]] = []
        codes = self.codes(doc)
        # A stretch holds at least so many equal words that count.
        equal = int(np.ceil(least * (1 - changed) - 1e-9))
        for k, places in self.seeds(codes).items():
            item = self.items[k]
            places = sorted({*places})
            if len(places) < 2:
                continue
            group: list[int] = []
            for p in [*places, None]:
                if p is not None and (not group or p - group[-1] <= REACH + len(item.words) // 4):
                    group.append(p)
                    continue
                if len(group) > 1:
                    n = len(item.words)
                    lo, hi = max(0, group[0] - n), min(len(doc), group[-1] + n)
                    # What a stretch scores at least, were no word inserted; half of it leaves room for those.
                    could = least * (2 - 3 * changed) / 2
                    for at in range(lo, max(lo + 1, hi - 2 * n), 2 * n):
                        for place, how in alignments(item, doc, codes, at, min(hi, at + 4 * n), self.spelling, could, equal):
                            s = stretch(item, place, how, least, changed)
                            if s:
                                found.append((*s, item.id))
                group = [p] if p is not None else []
        out = []
        for eq, lo, hi, i in found:
            rival = [x for x in found if x[3] != i and min(hi, x[2]) - max(lo, x[1]) >= 0.5 * min(hi - lo, x[2] - x[1])]
            if all(x[0] < eq for x in rival):
                out.append(i)
        return out


def _grams(n: int):
    return lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, n)))).otherwise(F.array().cast("array<string>"))


def prepared(items: DataFrame, item: str, text: str) -> DataFrame:
    """Rows (item, ``words``, ``counts`` array<boolean>, ``seeds`` array<string>) of the items."""

    @F.pandas_udf("array<string>")
    def split(s):  # noqa: ANN001, ANN202
        return s.map(words)

    base = items.select(F.col(item).alias("_i"), split(F.col(text)).alias("words")).filter(F.col("_i").isNotNull() & (F.size("words") > 0)).dropDuplicates()
    w = F.col("words")
    at = lambda n: F.transform(_grams(n)(w), lambda x, p: F.struct(x.alias("g"), F.floor(p / SEED_WORDS).alias("b")))
    g = base.select("_i", "words", F.explode(F.concat(at(2), at(3))).alias("x")).select("_i", "words", "x.g", "x.b")
    n_items = g.groupBy("g").agg(F.count_distinct("_i").alias("n"))
    counted = g.join(n_items, "g")
    rare = counted.filter(F.col("n") <= SEED_ITEMS).select("_i", "words", "g")
    rarest = counted.groupBy("_i", "words", "b").agg(F.min(F.struct("n", "g")).alias("m"))
    near = W.partitionBy("_i", "words").orderBy("b").rowsBetween(-1, 1)  # an item's places
    rarest = rarest.withColumn("_near", F.sum(F.when(F.col("m.n") <= SEED_ITEMS, 1).otherwise(0)).over(near)).filter("_near <= 1").select("_i", "words", F.col("m.g").alias("g"))
    seeds = rare.unionByName(rarest).groupBy("_i", "words").agg(F.collect_set("g").alias("seeds"))
    runs = base.select("_i", "words", F.posexplode(_grams(SHARED)(w)).alias("p", "g"))
    several = runs.groupBy("g").agg(F.count_distinct("_i").alias("n")).filter(F.col("n") > 1).select("g")
    masked = runs.join(several, "g").groupBy("_i", "words").agg(F.collect_set("p").alias("ps"))
    out = seeds.join(masked, ["_i", "words"], "left")
    free = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: ~F.exists(F.coalesce("ps", F.array().cast("array<int>")), lambda p: (p <= i) & (i < p + SHARED)))
    return out.select("_i", "words", free.alias("counts"), "seeds")


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 18, changed: float = 0.3) -> DataFrame:
    """Rows (``doc``, ``item``): the items that leaked into each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leakage")
    kinds = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    ready = scratch.keep(prepared(items, item, item_text))
    blocks = max(1, -(-ready.count() // BLOCK))
    schema = f"`{doc}` {kinds[0]}, `{item}` {kinds[1]}"
    out = None
    for b in range(blocks):
        rows = ready if blocks == 1 else ready.filter(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r["_i"], r["words"], r["counts"], r["seeds"]) for r in rows.toLocalIterator()])

        def work(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value)
            for p in parts:
                ids, found = p.column(0).to_pylist(), []
                for i, t in zip(ids, p.column(1).to_pylist()):
                    found += [(i, x) for x in dict.fromkeys(block.find(words(t), least, changed))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], p.schema[0].type), pa.array([x[1] for x in found])], names=[doc, item])

        part = docs.select(F.col(doc), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
