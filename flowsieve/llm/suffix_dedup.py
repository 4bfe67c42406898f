"""Repeated byte strings across documents by a depth-limited radix sort of suffixes.

A byte is removed if a string of ``LENGTH`` (50) bytes over it also starts in a document with
a smaller id. Suffixes only need ordering through 50 bytes, and groups that are equal to that
depth are exactly the repeated windows. The sort runs by most-significant-digit passes that
drop suffixes as soon as they are alone:

* distribution: every window has one anchor, the 24-byte string in it with the smallest hash.
  Anchors, not all positions, are grouped (about 1 in 14), by 32 bits within a bucket of the
  leading bits; anchors alone there are done. Only one bit a suffix comes back.
* copies: the windows that share an anchor form a span of at most 76 bytes. Equal spans are
  joined in the slab (copies there need no exchange), then in their anchor's bucket; of
  equal spans all but the smallest document's are repeats, in full.
* radix passes: the suffixes in the first spans of anchors with several different spans are
  ordered by one eight-byte digit after the other, most significant first, through 50 bytes and no
  deeper (``ordered``). A pass splits each group by its next digit and drops suffixes that are alone.
  Bytes that all suffixes of a group share, those of the anchor, need no pass.

A hot passage sends each of its spans at most once per slab. Texts are shuffled once
(``slabs``) and each pass streams over short pieces of a slab.

Cases: null text is empty text; a null id sorts after all ids and null ids do not remove from
each other; rows with the same id do not remove from each other; texts under 50 bytes are
untouched; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .slabs import NULL_ID, Slab, bucket_of, cut, deal, each_slab, unzip_bytes, zip_bytes

LENGTH, GRAM, PIECE = 50, 24, 1 << 16
REACH = LENGTH - GRAM  # an anchor starts at most this far into its window
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _grams(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 24-byte strings of ``b``."""
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    g = x[:-16] * _M[0]
    g ^= g >> np.uint64(29)
    g += x[8:-8] * _M[1]
    g ^= g >> np.uint64(31)
    g *= _M[2]
    g += x[16:]
    g ^= g >> np.uint64(32)
    g *= _M[3]
    g ^= g >> np.uint64(29)
    return g


def spans(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor offset and anchor hash of every span of a slab."""
    buf = np.frombuffer(slab.data, np.uint8)
    windows = len(buf) - LENGTH + 1
    if windows <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    valid = np.ones(len(buf), bool)
    last = slab.ends[:, None] - 1 - np.arange(LENGTH - 1)[None, :]
    valid[last[last >= slab.starts[:, None]]] = False
    out = []
    for lo in range(0, windows, PIECE):
        hi = min(windows, lo + PIECE)
        if not valid[lo:hi].any():
            continue
        g = _grams(buf[lo:hi + LENGTH - 1])
        m = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[:-(REACH + 1 - 16)], m[REACH + 1 - 16:])
        anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(valid[lo:hi])
        a = anchor[at]
        s = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (a[1:] != a[:-1])])
        out.append((at[s] + lo, np.diff(np.r_[s, len(at)]), a[s] - at[s], g[a[s]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    p0, n, off, gram = map(np.concatenate, zip(*out))
    return p0, n, off, (gram ^ gram >> np.uint64(32)) * _M[0]  # smallest hashes were chosen: spread them again


def _groups(words: np.ndarray) -> np.ndarray:
    """Group number of each row of a table of 64-bit words; equal rows, exactly, have equal numbers."""
    h = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _M[i % 4]
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    if (~same & (h[order[1:]] == h[order[:-1]])).any():  # a hash collision: sort by all words
        order = np.lexsort(words.T)
        same = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    number = np.empty(len(words), np.int64)
    number[order] = np.cumsum(np.r_[0, ~same]) if len(words) else 0
    return number


def _smallest(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each row's group."""
    low = np.full(int(group.max()) + 1 if len(group) else 0, NULL_ID, np.int64)
    np.minimum.at(low, group, doc)
    return low[group]


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    return wide.view(np.uint64)


def ordered(digits: np.ndarray, at: np.ndarray, group: np.ndarray, depths: list[int]) -> np.ndarray:
    """Most-significant-digit passes over the suffixes at ``at``, already split into ``group``.

    ``digits[i]`` is the eight-byte digit at byte i; ``depths`` are the digits' places in a suffix, in
    order. Gives the number of the group of suffixes equal in all of them, -1 where a suffix is alone.
    """
    number, live = np.full(len(at), -1, np.int64), np.arange(len(at))
    for depth in depths:
        digit = digits[at[live] + depth].astype(np.uint64)
        order = np.lexsort((digit, group))
        digit, group, live = digit[order], group[order], live[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])][:len(live)]
        size = np.diff(np.r_[np.flatnonzero(new), len(live)])
        keep = np.repeat(size > 1, size)
        group, live = np.cumsum(new)[keep], live[keep]
        if not len(live):
            return number
    number[live] = group
    return number


def _depths(lo: int, hi: int) -> list[int]:
    """Places of the eight-byte digits that cover bytes ``lo`` to ``hi``; the last may overlap the one before."""
    return [min(d, hi - 8) for d in range(lo, hi, 8)]


def repeated_windows(mat: np.ndarray, off: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For spans aligned at their anchor in the rows of ``mat``: which windows (by column) a smaller document has."""
    gone = np.zeros((len(mat), REACH + 1), bool)
    if not len(mat):
        return gone
    mat = np.ascontiguousarray(mat)
    width = mat.shape[1]
    digits = np.ndarray((mat.size - 7,), ">u8", mat, strides=(1,))
    anchor = ordered(digits, np.arange(len(mat)) * width, np.zeros(len(mat), np.int64), _depths(REACH, REACH + GRAM))
    several = np.flatnonzero(anchor >= 0)
    first = REACH - off
    for c in range(REACH + 1):  # suffixes at one distance before their anchor
        rows = several[(first[several] <= c) & (c < first[several] + n[several])]
        if len(rows) > 1:
            depths = _depths(0, REACH - c) if REACH - c >= 8 else [0] if c < REACH else []
            g = ordered(digits, rows * width + c, anchor[rows], depths + _depths(REACH - c + GRAM, LENGTH))
            same = np.flatnonzero(g >= 0)
            gone[rows[same], c] = doc[rows[same]] > _smallest(g[same], doc[rows[same]])
    return gone


def _local(slab: Slab, answers: pd.DataFrame | None, n_buckets: int) -> pd.DataFrame:
    """Copies inside a slab: repeats settled here, and each remaining span once, by bucket."""
    p0, n, off, gram = spans(slab)
    u, inv, count = np.unique(gram, return_inverse=True, return_counts=True)
    bits = np.zeros(len(u), bool)
    got = {int(b): x for b, x in zip(answers["bucket"], answers["bits"])}
    for b, s, e in cut(bucket_of(u, n_buckets)):
        bits[s:e] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=e - s).astype(bool)
    keep = np.flatnonzero((bits | (count > 1))[inv])
    doc = slab.ids[np.searchsorted(slab.ends, p0[keep], "right")]
    data, seen, done = slab.data, {}, []
    for i, p, k, o, d in zip(keep.tolist(), p0[keep].tolist(), n[keep].tolist(), off[keep].tolist(), doc.tolist()):
        key = (o, data[p:p + k + LENGTH - 1])
        e = seen.get(key)
        if e is None:
            seen[key] = (d, [p], i)
        elif d == e[0]:
            e[1].append(p)
        elif d > e[0]:
            done.append((p, p + k + LENGTH - 1))
        else:
            done.extend((q, q + k + LENGTH - 1) for q in e[1])
            seen[key] = (d, [p], i)
    rows = [{"bucket": slab.slab % n_buckets, "slab": slab.slab, "docs": None, "offs": None, "ns": None, "occs": None,
             "at": np.array(done, np.int64).tobytes(), "spans": None}] if done else []
    items = list(seen.items())
    if items:
        g = gram[[v[2] for _, v in items]]
        order = np.argsort(g, kind="stable")
        for b, s, e in cut(bucket_of(g[order], n_buckets)):
            part = [items[j] for j in order[s:e].tolist()]
            rows.append({"bucket": b, "slab": slab.slab,
                         "docs": zip_bytes(np.array([v[0] for _, v in part], np.int64).tobytes()),
                         "offs": bytes(k[0] for k, _ in part),
                         "ns": bytes(len(k[1]) - LENGTH + 1 for k, _ in part),
                         "occs": zip_bytes(np.array([len(v[1]) for _, v in part], np.uint32).tobytes()),
                         "at": np.array([p for _, v in part for p in v[1]], np.uint32).tobytes(),
                         "spans": zip_bytes(b"".join(k[1] for k, _ in part))})
    return pd.DataFrame(rows, columns=["bucket", "slab", "docs", "offs", "ns", "occs", "at", "spans"])


def _aligned(blobs, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Spans as rows of bytes with their anchors in one column; filled a few thousand rows at a time."""
    flat = np.frombuffer(b"".join(map(unzip_bytes, blobs)), np.uint8)
    mat = np.zeros((len(n), 2 * REACH + GRAM), np.uint8)
    size = n + LENGTH - 1
    ends = np.cumsum(size)
    for lo in range(0, len(n), 1 << 13):
        k = size[lo:lo + (1 << 13)]
        start = ends[lo] - size[lo]
        here = flat[start:start + k.sum()]
        col = np.arange(len(here)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(REACH - off[lo:lo + (1 << 13)], k)
        mat[np.repeat(np.arange(lo, lo + len(k)), k), col] = here
    return mat


def _union(slab: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """Overlapping ranges of a slab joined, as bytes by slab (documents never overlap)."""
    order = np.lexsort((start, slab))
    slab, start, end = slab[order], start[order], end[order]
    out = []
    for b, i, j in cut(slab):
        s, upto = start[i:j], np.maximum.accumulate(end[i:j])
        new = np.flatnonzero(np.r_[True, s[1:] >= upto[:-1]])
        out.append((b, np.stack([s[new], upto[np.r_[new[1:] - 1, j - i - 1]]], axis=1).tobytes()))
    return out


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies and radix passes in a bucket: removed ranges by slab."""
    out = [(int(s), a) for s, a, d in zip(pdf["slab"], pdf["at"], pdf["docs"]) if d is None]
    pdf = pdf[pdf["docs"].notna()]
    if len(pdf):
        doc = np.frombuffer(b"".join(map(unzip_bytes, pdf["docs"])), np.int64)
        off = np.frombuffer(b"".join(pdf["offs"]), np.uint8).astype(np.int64)
        n = np.frombuffer(b"".join(pdf["ns"]), np.uint8).astype(np.int64)
        occ = np.frombuffer(b"".join(map(unzip_bytes, pdf["occs"])), np.uint32).astype(np.int64)
        at = np.frombuffer(b"".join(pdf["at"]), np.uint32)
        slab = np.repeat(pdf["slab"].to_numpy(np.int64), [len(x) for x in pdf["offs"]])
        mat = _aligned(pdf["spans"], off, n)
        same = _groups(np.concatenate([_words(mat), (off << 8 | n).astype(np.uint64)[:, None]], axis=1))
        low = _smallest(same, doc)
        first = np.flatnonzero(doc == low)
        first = first[np.unique(same[first], return_index=True)[1]]  # one row for each distinct span
        gone = np.zeros((len(n), REACH + 1), bool)
        gone[first] = repeated_windows(mat[first], off[first], n[first], doc[first])
        by_group = np.empty(int(same.max()) + 1, np.int64)
        by_group[same[first]] = first
        gone = gone[by_group[same]]
        cols = np.arange(REACH + 1)[None, :]
        mine = (cols >= (REACH - off)[:, None]) & (cols < (REACH - off + n)[:, None])
        gone = np.where((doc > low)[:, None], mine, gone & mine)
        some = np.flatnonzero(gone.any(axis=1))
        edge = np.zeros((len(some), REACH + 3), np.int8)
        edge[:, 1:-1] = gone[some]
        edge = np.diff(edge, axis=1)
        r, s = np.nonzero(edge == 1)
        _, e = np.nonzero(edge == -1)
        r = some[r]
        begin, stop = s - (REACH - off[r]), e - 1 - (REACH - off[r]) + LENGTH
        base = np.cumsum(occ) - occ  # every occurrence of the span has the same ranges
        chunk = np.cumsum(occ[r]) >> 18
        for _, i, j in cut(chunk):
            q = r[i:j]
            k = np.repeat(np.arange(i, j), occ[q])
            p = at[np.repeat(base[q] - np.cumsum(occ[q]) + occ[q], occ[q]) + np.arange(len(k))].astype(np.int64)
            out += _union(slab[r[k]], p + begin[k], p + stop[k])
    return pd.DataFrame(out, columns=["slab", "ranges"])


def _remove(slab: Slab, answers: pd.DataFrame) -> pd.DataFrame:
    """Merged removed runs of each document of a slab, and what is left."""
    got = np.frombuffer(b"".join(answers["ranges"]), np.int64).reshape(-1, 2) if len(answers) else np.zeros((0, 2), np.int64)
    got = got[np.lexsort((got[:, 1], got[:, 0]))]
    doc = np.searchsorted(slab.ends, got[:, 0], "right")
    upto = np.maximum.accumulate(got[:, 1]) if len(got) else got[:, 1]
    s = np.flatnonzero(np.r_[True, (got[1:, 0] > upto[:-1]) | (doc[1:] != doc[:-1])]) if len(got) else np.zeros(0, np.int64)
    runs = {}
    for d, a, b in zip(doc[s].tolist(), got[s, 0].tolist(), upto[np.r_[s[1:] - 1, len(got) - 1]].tolist() if len(s) else []):
        runs.setdefault(d, []).append((a, b))
    out, data = [], memoryview(slab.data)
    for i, (d, a, b) in enumerate(zip(slab.ids.tolist(), slab.starts.tolist(), slab.ends.tolist())):
        mine, h, at = runs.get(i, ()), hashlib.sha256(), a
        for x, y in mine:
            h.update(data[at:x])
            at = y
        h.update(data[at:b])
        out.append((None if d == NULL_ID else d, b - a, sum(y - x for x, y in mine), len(mine), h.hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    table, n = deal(docs)

    def anchors(slab, _):
        u = np.unique(spans(slab)[3])
        return pd.DataFrame([(b, slab.slab, u[s:e].astype(np.uint32).tobytes()) for b, s, e in cut(bucket_of(u, n))],
                            columns=["bucket", "slab", "low"])

    def alone(pdf):
        size = np.array([len(x) // 4 for x in pdf["low"]])
        low = np.frombuffer(b"".join(pdf["low"]), np.uint32)
        order = np.argsort(low, kind="stable")
        same = low[order[1:]] == low[order[:-1]]
        shared = np.zeros(len(low), bool)
        shared[order] = np.r_[same, False] | np.r_[False, same]
        ends = np.cumsum(size)
        return pd.DataFrame({"slab": pdf["slab"], "bucket": pdf["bucket"],
                             "bits": [np.packbits(shared[e - k:e]).tobytes() for e, k in zip(ends, size)]})

    shared = each_slab(table, anchors, "bucket long, slab long, low binary").groupBy("bucket").applyInPandas(
        alone, "slab long, bucket long, bits binary")
    sent = each_slab(table, lambda slab, got: _local(slab, got, n), (
        "bucket long, slab long, docs binary, offs binary, ns binary, occs binary, at binary, spans binary"), shared)
    ranges = sent.groupBy("bucket").applyInPandas(_settle, "slab long, ranges binary")
    return each_slab(table, _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ranges)
