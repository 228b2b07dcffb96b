"""Long stretches that stand letter by letter in more than one text.

Method: a log-structured fingerprint index. Of every window of ``length`` characters one place is chosen by content (the least
hash of its grams of ``GRAM`` characters), so that equal windows choose the same place. An index holds sorted immutable
runs of (fingerprint, doc, place); each new batch is joined with itself and merge-joined with the runs, its own sorted run is
added, and runs of like size are compacted into one. Candidates are verified on the texts: around an equal gram as many
characters as needed on either side are compared, which decides exactly whether a stretch of ``length`` lies there.

A stretch that repeats itself with a short period keeps its outermost places only. What of it is shared is reckoned from the
starts, ends and phases of such stretches of one unit.

Exact copies of a whole text are one class: only its first text is fingerprinted, and links are spread over members at the
end. Of a fingerprint that many texts share each text's surroundings move once, not once a pair.

Defined results: characters are Unicode code points, compared as written; null texts and those shorter than ``length`` share nothing;
stretches repeated within one text don't count; rows of one doc id and text count once; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.intervals import periods
from spanwright.session import Scratch

LENGTH = 500
GRAM = 300
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 19
_BLOCK = 4096
_PLACE = (1 << 20) - 1


class Fingerprints:
    """Places chosen by content, and the hashes there."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.pow = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)], dtype=np.uint64)
                self.inv = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes); long texts are taken in chunks that overlap by a window."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, max(1, len(c) - self.length + 1), _CHUNK):
            p, h = self._chunk(c[at : at + _CHUNK + self.length - 1])
            places.append(p + at)
            hashes.append(h)
        p, first = np.unique(np.concatenate(places), return_index=True)
        return p, np.concatenate(hashes)[first]

    def _chunk(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, g, w = len(c), self.gram, self.window
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.pow[:n], dtype=np.uint64)]
            h = (total[g:] - total[:-g]) * self.inv[: n - g + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        # Order: upper bits of the hash, then the later place. Minima of all windows by blocks of the window's width.
        m = len(h)
        key = (h & ~np.uint64(_PLACE)) | np.uint64(_PLACE) - np.arange(m, dtype=np.uint64)
        pad = -m % w
        blocks = np.r_[key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.unique(np.minimum(back[: m - w + 1], ahead[w - 1 : m]))
        p = np.sort((np.uint64(_PLACE) - (least & np.uint64(_PLACE))).astype(np.int64))
        p = self._thinned(p, h)
        return p, h[p]

    def _thinned(self, p: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of a stretch that repeats itself with a period under a window, whose places all bear one hash, the two outermost places on either side.

        Two texts with such a stretch are aligned by these: a window that leaves the stretch holds its outermost place on that side in
        both, and one that lies within the stretch in both is spanned by an alignment of an outermost or next place with such a one. So the
        outermost places stand for every such stretch, even if other places were chosen there.
        """
        d = np.arange(1, self.window)
        after, before = p[:, None] + d, p[:, None] - d
        after = (after < len(h)) & (h[np.minimum(after, len(h) - 1)] == h[p][:, None])
        before = (before >= 0) & (h[np.maximum(before, 0)] == h[p][:, None])
        if not (after.any() or before.any()):
            return p
        right = np.where(after.any(1), after.argmax(1) + 1, 0)
        left = np.where(before.any(1), before.argmax(1) + 1, 0)
        out, done = p[left != right].tolist() + p[(left == 0) & (right == 0)].tolist(), {}
        for i in np.flatnonzero((left > 0) | (right > 0)):
            lo = hi = at = int(p[i])
            for step in {int(left[i]), int(right[i])} - {0}:
                if at <= done.get((step, at % step), -1):
                    continue
                while lo >= step and h[lo - step] == h[at]:
                    lo -= step
                while hi + step < len(h) and h[hi + step] == h[at]:
                    hi += step
                done[step, at % step] = hi
                out += [lo, lo + step, hi - step, hi] if hi > lo else [lo]
                lo = hi = at
        return np.unique(np.array(out, np.int64))

    def repeats(self, text: str, places: np.ndarray) -> list[tuple[int, int, int, int, str]]:
        """(number of a place, period, start, end, hash of the unit from that place on): the stretches of ``length`` or more characters that
        repeat themselves with a period under a window and hold the gram of a place."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out, seen = [], {}
        for at in range(0, len(places), _BLOCK):
            p = places[at : at + _BLOCK]
            i, d = np.nonzero(c[p[:, None] + np.arange(1, self.window)] == c[p][:, None])
            d += 1
            for k in range(1, self.gram - self.window + 1):
                if not len(i):
                    break
                same = c[p[i] + d + k] == c[p[i] + k]
                i, d = i[same], d[same]
            units: dict[int, list[int]] = {}
            for n, q in zip(i.tolist(), d.tolist()):
                if any(q % u == 0 for u in units.get(n, ())):
                    continue
                x = int(p[n])
                if x + self.gram <= seen.get((q, x % q), 0):
                    units.setdefault(n, []).append(q)
                    continue
                s, e = _reach(c, x, q)
                if e < x + self.gram:
                    continue
                units.setdefault(n, []).append(q)
                seen[q, x % q] = e
                if e - s >= self.length:
                    out.append((at + n, q, s, e, hashlib.sha256(c[x : x + q].tobytes()).hexdigest()))
        return out


def _reach(c: np.ndarray, x: int, q: int) -> tuple[int, int]:
    """Start and end of the stretch around place ``x`` that repeats itself with period ``q``."""
    e, n = x, 1024
    while e + q < len(c):
        m = min(n, len(c) - q - e)
        differ = np.flatnonzero(c[e : e + m] != c[e + q : e + q + m])
        if len(differ):
            e += int(differ[0])
            break
        e, n = e + m, n * 2
    s, n = x, 1024
    while s > 0:
        m = min(n, s)
        differ = np.flatnonzero(c[s - m : s] != c[s - m + q : s + q])
        if len(differ):
            s -= m - 1 - int(differ[-1])
            break
        s, n = s - m, n * 2
    return s, e + q


def fingerprints(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (``_f`` bigint, ``_d``, ``_p`` int, ``_q``, ``_s``, ``_e`` bigint, ``_u``) of texts (``_d`` bigint, ``_t``). The last four are the period, start,
    end and hashed unit of a stretch that repeats itself around the place, null where none is; a place has a row for each."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprints(length, gram)
        for b in parts:
            ids, ps, hs, rs, n = [], [], [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, h = f.of(t)
                ids.append(np.full(len(p), d, np.int64))
                ps.append(p)
                hs.append(h.view(np.int64))
                rs += [(n + r[0], *r[1:]) for r in f.repeats(t, p)]
                n += len(p)
            if ids:
                fs, ds, at = np.concatenate(hs), np.concatenate(ids), np.concatenate(ps).astype(np.int32)
                k = np.array([r[0] for r in rs], np.int64)
                plain = np.ones(n, bool)
                plain[k] = False
                for i, m in ((np.flatnonzero(plain), None), (k, rs)):
                    tail = [pa.array([r[j] for r in m], kind) if m is not None else pa.nulls(len(i), kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()), 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(fs[i]), pa.array(ds[i]), pa.array(at[i]), *tail], names=["_f", "_d", "_p", "_q", "_s", "_e", "_u"])

    return docs.select("_d", "_t").mapInArrow(work, "_f bigint, _d bigint, _p int, _q bigint, _s bigint, _e bigint, _u string")


class FingerprintIndex:
    """Runs of fingerprints, sorted and never changed, of which like-sized ones are compacted."""

    def __init__(self, spark: SparkSession) -> None:
        self.scratch, self.runs, self.hits = Scratch(spark, "shared"), [], []

    def _run(self, df: DataFrame) -> DataFrame:
        return self.scratch.keep(df.repartition("_f").sortWithinPartitions("_f", "_d", "_p"))

    def add(self, fresh: DataFrame) -> None:
        """Adds a batch of fingerprints and notes those (``_f``, ``_d``, ``_p``) that another text shares, on either side."""
        run = self._run(fresh)
        old = None
        for _, r in self.runs:
            old = r if old is None else old.unionByName(r)
        # Distinct texts a fingerprint, counted map-side; a fingerprint of one text alone needs no row beyond this.
        seen = run.select("_f", F.lit(1).alias("_new"), "_d")
        if old is not None:
            seen = seen.unionByName(old.join(run.select("_f").distinct(), "_f", "left_semi").select("_f", F.lit(0).alias("_new"), "_d"))
        several = seen.groupBy("_f").agg(F.min("_d").alias("_a"), F.max("_d").alias("_b")).filter("_a <> _b").select("_f")
        several = self.scratch.keep(several)
        self.hits.append(run.join(several, "_f", "left_semi"))
        if old is not None:
            self.hits.append(old.join(several, "_f", "left_semi"))
        level = 0
        self.runs.append((level, run))
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, a), (_, b) = self.runs.pop(), self.runs.pop()
            self.runs.append((level + 1, self._run(a.unionByName(b))))

    def shared(self) -> DataFrame:
        """Rows (``_f``, ``_d``, ``_p``) of fingerprints that several texts have."""
        out = self.hits[0]
        for h in self.hits[1:]:
            out = out.unionByName(h)
        return self.scratch.keep(out.distinct())


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _verify(length: int, gram: int):
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            a, d, pa_, pd_, la, ld, ra, rd = (c.to_pylist() for c in b.columns)
            out = []
            for i in range(len(a)):
                right = _common(ra[i], rd[i])
                if right < gram:
                    continue
                left = _common(la[i][::-1], ld[i][::-1])
                if left + right >= length:
                    out.append((a[i], d[i], pa_[i] - left, pd_[i] - left, left + right))
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array([o[k] for o in out], pa.int64()) for k, n in enumerate(("_a", "_b", "_sa", "_sb", "_len"))})

    return work


class SharedStretches:
    """``members`` (``_d``, ``_r``): texts of at least ``length`` and the first doc with the same text; ``stretches`` (``_a``, ``_b``, ``_sa``, ``_sb``,
    ``_len``): verified pieces of stretches between first docs, ``_a`` < ``_b``, at places ``_sa`` and ``_sb``; pieces of one stretch overlap."""

    def __init__(self, docs: DataFrame, doc: str, text: str, batches: int = 4, length: int = LENGTH, gram: int = GRAM) -> None:
        spark = docs.sparkSession
        long = docs.select(F.col(doc).cast("long").alias("_d"), F.col(text).alias("_t")).filter(F.col("_d").isNotNull() & (F.char_length("_t") >= length))
        index = FingerprintIndex(spark)
        keep = index.scratch.keep
        named = long.select("_d", F.sha2("_t", 256).alias("_h")).distinct()
        first = named.groupBy("_h").agg(F.min("_d").alias("_r"))
        self.members = keep(named.join(first, "_h").select("_d", "_r").distinct())
        firsts = self.members.filter("_d = _r").select("_d")
        # A doc id whose rows hold different texts is rare; each of its texts is read.
        fp = keep(fingerprints(long.join(firsts, "_d", "left_semi"), length, gram))
        for b in range(batches):
            index.add(fp.filter(F.pmod(F.xxhash64("_d"), F.lit(batches)) == b).select("_f", "_d", "_p"))
        hits = index.shared()
        rim = length - gram
        texts = long.join(hits.select("_d").distinct(), "_d", "left_semi").distinct()
        p = F.col("_p")
        around = keep(
            hits.join(texts, "_d").select("_f", "_d", "_p", F.substring(F.col("_t"), F.greatest(p - rim, F.lit(0)) + 1, F.least(p, F.lit(rim))).alias("_l"), F.substring(F.col("_t"), p + 1, F.lit(length)).alias("_rt"))
        )
        a = around.select("_f", F.col("_d").alias("_a"), F.col("_p").alias("_pa"), F.col("_l").alias("_la"), F.col("_rt").alias("_ra"))
        b = around.select("_f", F.col("_d").alias("_b"), F.col("_p").alias("_pb"), F.col("_l").alias("_lb"), F.col("_rt").alias("_rb"))
        pairs = a.join(b, "_f").filter("_a < _b").select("_a", "_b", "_pa", "_pb", "_la", "_lb", "_ra", "_rb")
        self.stretches = keep(pairs.mapInArrow(_verify(length, gram), "_a bigint, _b bigint, _sa bigint, _sb bigint, _len bigint"))
        self.long, self.length = long, length
        self.repeats = fp.filter("_q is not null").distinct()

    def pairs(self) -> DataFrame:
        """Rows (``_a``, ``_b``), smaller id first: all docs that share a stretch, members of classes included."""
        m = self.members
        linked = self.stretches.select("_a", "_b").distinct()
        left, right = m.select(F.col("_d").alias("_x"), F.col("_r").alias("_a")), m.select(F.col("_d").alias("_y"), F.col("_r").alias("_b"))
        across = linked.join(left, "_a").join(right, "_b").select("_x", "_y")
        within = left.join(right.withColumnRenamed("_b", "_a"), "_a").filter("_x < _y").select("_x", "_y")
        both = across.unionByName(within).filter("_x <> _y")
        return both.select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct()

    def _repeated(self) -> DataFrame:
        """Rows (``_d``, ``s``, ``e``): the parts of stretches that repeat themselves which windows cover that stand in a stretch of the same unit of another doc.

        The other stretch has windows of ``_n`` phases, from ``_r`` on; those of this one with such a phase follow each other within a
        period, so that they cover all from the first to the last.
        """
        q, length = F.col("_q"), F.lit(self.length)
        other = self.repeats.select("_f", "_q", "_u", F.col("_d").alias("_o"), F.pmod(F.col("_s") - F.col("_p"), q).alias("_r"), F.least(F.col("_e") - F.col("_s") - length + 1, q).alias("_n")).distinct()
        both = self.repeats.join(other, ["_f", "_q", "_u"]).filter("_d <> _o")
        last = F.col("_e") - length
        u, v = F.pmod(F.col("_s") - F.col("_p") - F.col("_r"), q), F.pmod(last - F.col("_p") - F.col("_r"), q)
        first = F.when(u < F.col("_n"), F.col("_s")).otherwise(F.col("_s") + q - u)
        last = F.when(v < F.col("_n"), last).otherwise(last - (v - F.col("_n") + 1))
        return both.select("_d", first.alias("s"), (last + length).alias("e")).filter(F.col("e") - F.col("s") >= length).distinct()

    def coverage(self) -> DataFrame:
        """Rows (``_d``, ``n_chars``, ``n_shared``): of each long text how many characters stand in shared stretches."""
        s = self.stretches
        piece = s.select(F.col("_a").alias("_d"), F.col("_sa").alias("s"), (F.col("_sa") + F.col("_len")).alias("e")).unionByName(s.select(F.col("_b").alias("_d"), F.col("_sb").alias("s"), (F.col("_sb") + F.col("_len")).alias("e")))
        piece = piece.unionByName(self._repeated())
        merged = periods(piece.distinct(), "_d", "s", "e").groupBy("_d").agg(F.sum(F.col("period_end") - F.col("period_start")).alias("n")).withColumnRenamed("_d", "_r")
        copies = self.members.groupBy("_r").agg(F.count(F.lit(1)).alias("c"))
        sizes = self.long.select("_d", F.char_length("_t").cast("long").alias("n_chars")).groupBy("_d").agg(F.max("n_chars").alias("n_chars"))
        out = self.members.join(copies, "_r").join(merged, "_r", "left").join(sizes, "_d")
        return out.select("_d", "n_chars", F.when(F.col("c") > 1, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_shared"))
