"""Periodic runs of words by internal pattern matching.

A run is a stretch of words of smallest period q, at least ``max(LEAST, TIMES * q)`` long, that no
neighbouring word extends. Texts of a batch are laid end to end, each closed by a separator of
its own, so that no match crosses a text:

1. *Suffix array* by prefix doubling. The ranks of every round are kept: suffixes with the rank of
   round k share their first 2^k words and form one interval of the array.
2. *Dyadic blocks*: a run of period q in [b, 2b), b = 2^k, holds a whole aligned block of b words whose
   next copy q words on lies in the run too. So each aligned block asks for its occurrences
   that start b to 2b - 1 words after it: a *range successor* query (smallest position not below
   x in an interval of the suffix array), answered on a wavelet tree of the array.
3. Those occurrences form one arithmetic *progression*. One or two members are candidate
   periods themselves. From three on the block has a short period; its periodic stretch and that of the
   last occurrence must end q apart if both lie in a longer run, which leaves one candidate.
4. A candidate is stretched both ways by longest common extensions over the kept ranks. Of equal stretches
   the smallest period counts (the others are its multiples).

No shuffle; a task holds one batch of about ``BATCH`` words, or one longer text, at about 8 bytes a word and round
of doubling (one round for each doubling of the longest repeat) and as much for the tree.

Cases: null and empty texts have no words and no runs; ids may be null or repeated, each row is judged
alone; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

LEAST, TIMES = 6, 4
BATCH = 1 << 16
FIELDS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, "
          "collapsed string")


class Suffixes:
    """Suffix array of ``codes`` (separators negative and distinct) with the ranks of all rounds, at least two."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        _, first = np.unique(codes, return_inverse=True)
        self.ranks, self.sizes = [], []
        self.sa = self._round(first.astype(np.int64))
        width = 1
        while width < n and (width == 1 or self.sizes[-1].max() > 1):
            rank = self.ranks[-1].astype(np.int64)
            nxt = np.zeros(n, np.int64)  # 0: past the end, before every rank + 1
            nxt[:n - width] = rank[width:] + 1
            self.sa = self._round(rank * (n + 1) + nxt)
            width *= 2

    def _round(self, key: np.ndarray) -> np.ndarray:
        """Ranks by ``key``: the first place of each group in the order, and the group's size there."""
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[start, self.n])
        rank = np.empty(self.n, np.int32)
        rank[order] = np.repeat(start, size)
        at = np.zeros(self.n, np.int32)
        at[start] = size
        self.ranks.append(rank)
        self.sizes.append(at)
        return order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` (i < j) on."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            ok = np.flatnonzero(j + (1 << k) <= self.n)
            ok = ok[self.ranks[k][i[ok]] == self.ranks[k][j[ok]]]
            for a in (i, j, out):
                a[ok] += 1 << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words that end before ``i`` and ``j`` (i < j)."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            ok = np.flatnonzero(i >= 1 << k)
            ok = ok[self.ranks[k][i[ok] - (1 << k)] == self.ranks[k][j[ok] - (1 << k)]]
            i[ok] -= 1 << k
            j[ok] -= 1 << k
            out[ok] += 1 << k
        return out


class WaveletTree:
    """Levelled bit vectors of a permutation: counts and k-th smallest values of its intervals."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, v = [], values
        for b in range(self.bits - 1, -1, -1):
            one = (v >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            v = np.concatenate([v[~one], v[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are below ``x`` (x at most 2^bits - 1, or more: all)."""
        every, x = x >> self.bits > 0, np.minimum(x, (1 << self.bits) - 1)
        lo, hi, whole, out = lo.astype(np.int64), hi.astype(np.int64), (hi - lo).astype(np.int64), np.zeros(len(lo), np.int64)
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1)):
            zl, zh, one = z[lo].astype(np.int64), z[hi].astype(np.int64), (x >> b & 1).astype(bool)
            out += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, z[-1] + lo - zl, zl), np.where(one, z[-1] + hi - zh, zh)
        return np.where(every, whole, out)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of [lo, hi); there must be more than k."""
        lo, hi, k, out = lo.astype(np.int64), hi.astype(np.int64), k.copy(), np.zeros(len(lo), np.int64)
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1)):
            zl, zh = z[lo].astype(np.int64), z[hi].astype(np.int64)
            one = k >= zh - zl
            k = np.where(one, k - (zh - zl), k)
            out += np.where(one, 1 << b, 0)
            lo, hi = np.where(one, z[-1] + lo - zl, zl), np.where(one, z[-1] + hi - zh, zh)
        return out


def runs(codes: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs; no text in ``codes`` has more than ``longest`` words."""
    if len(codes) < LEAST:
        return np.zeros((0, 3), np.int64)
    s = Suffixes(codes)
    tree, at, period = None, [], []
    for k in range(len(s.ranks)):
        b = 1 << k
        if TIMES * b > longest:
            break
        block = np.arange(0, s.n - b, b)
        lo = s.ranks[k][block].astype(np.int64)
        size = s.sizes[k][lo].astype(np.int64)
        block, lo, hi = block[size > 1], lo[size > 1], (lo + size)[size > 1]
        if not len(block):
            continue
        if k == 0:  # the only place is the next word
            block = block[codes[block] == codes[block + 1]]
            at.append(block)
            period.append(np.ones(len(block), np.int64))
            continue
        tree = tree or WaveletTree(s.sa)
        first = tree.below(lo, hi, block + b)
        count = tree.below(lo, hi, block + 2 * b) - first
        some = np.flatnonzero(count)
        block, lo, hi, first, count = (a[some] for a in (block, lo, hi, first, count))
        p1 = tree.smallest(lo, hi, first)
        few = count < 3
        at.append(block[few])
        period.append((p1 - block)[few])
        two = np.flatnonzero(count > 1)
        p2 = tree.smallest(lo[two], hi[two], first[two] + 1)
        pair = count[two] == 2
        at.append(block[two[pair]])
        period.append((p2 - block[two])[pair])
        many, d = two[~pair], (p2 - p1[two])[~pair]
        last = tree.smallest(lo[many], hi[many], (first + count)[many] - 1)
        here = block[many] + d + s.forward(block[many], block[many] + d)
        there = last + d + s.forward(last, last + d)
        q = there - here
        ok = (q >= b) & (q < 2 * b)
        at.append(block[many][ok])
        period.append(q[ok])
    if not at:
        return np.zeros((0, 3), np.int64)
    i, q = np.concatenate(at), np.concatenate(period)
    end = i + q + s.forward(i, i + q)
    start = i - s.backward(i, i + q)
    keep = end - start >= np.maximum(LEAST, TIMES * q)
    found = np.stack([start, end, q], axis=1)[keep]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)] if len(found) else np.zeros(0, bool)
    return found[new]


def _answer(doc_id, words: list, mine: list) -> dict:
    """The row of one text: ``mine`` are its runs (start, length, period) by start, then period."""
    best = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    drop = bytearray(len(words))
    for s, length, q in mine:
        drop[s + q:s + length] = b"\1" * (length - q)
    kept = b" ".join([w for w, d in zip(words, drop) if not d] if mine else words)
    return {"doc_id": doc_id, "n_runs": len(mine), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if mine else None,
            "runs_sha256": hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in mine)).hexdigest(),
            "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
            "runs": [dict(zip(("start", "length", "period"), r)) for r in mine], "collapsed": kept.decode("utf-8", "replace")}


def _solve(group: list) -> list[dict]:
    """Answers of (id, words) pairs worked on together."""
    code: dict = {}
    flat = []
    for _, words in group:
        flat.extend([code.setdefault(w, len(code)) for w in words])
        flat.append(-1)
    codes = np.array(flat, np.int64)
    ends = np.flatnonzero(codes < 0)
    codes[ends] = -1 - np.arange(len(ends))  # separators differ
    starts = np.r_[0, ends[:-1] + 1]
    found = runs(codes, int((ends - starts).max()))
    doc = np.searchsorted(ends, found[:, 0])
    by_doc: dict = {}
    for d, (s, e, q) in zip(doc.tolist(), found.tolist()):
        by_doc.setdefault(d, []).append((s - int(starts[d]), e - s, q))
    return [_answer(i, words, sorted(by_doc.get(d, []), key=lambda r: (r[0], r[2])))
            for d, (i, words) in enumerate(group)]


def find_runs(docs: DataFrame, batch_words: int = BATCH, collapsed: bool = True) -> DataFrame:
    """One row for each row of ``docs``: the runs of its words, the greatest one, and the text without repetitions.

    ``collapsed=False`` leaves out the array of runs and the collapsed text (their hashes stay).
    """
    import pyarrow as pa

    fields = FIELDS if collapsed else FIELDS.split(", runs array")[0]
    empty = docs.sparkSession.createDataFrame([], fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(empty.schema)

    def solve(batches):
        group, words = [], 0

        def flush():
            rows = _solve(group)
            return pa.RecordBatch.from_pylist([{f: r[f] for f in schema.names} for r in rows], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = (t.as_py() or b"").split()  # the blanks of bytes.split are exactly \x20 and \x09-\x0D
                if group and words + len(w) > batch_words:
                    yield flush()
                    group, words = [], 0
                group.append((i, w))
                words += len(w)
        if group:
            yield flush()

    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(solve, fields)


def plant(docs: DataFrame) -> DataFrame:
    """The contract's test texts: (doc_id, text) where every tenth text, by crc32 of its id, ends periodically."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    src = texts(docs).withColumn("h", h).withColumn("words", F.when(
        F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    src = src.withColumn("a", F.when(n > 0, g % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    planted = F.expr("array_join(transform(words, (w, i) -> IF(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return src.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
