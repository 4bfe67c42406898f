"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked at a Hamming distance of 2 or less. The anchors are the
codewords of a product of two perfect binary Golay codes on bits 0-22 and 23-45 (the last 18
bits are free): every fingerprint has exactly one home anchor within distance 3 in each
block, so the covering radius is 3 + 3. A fingerprint within 2 bits of x lies within
distance 3 + f of x's home in the one block and 3 + g in the other, f + g <= 2; so each
fingerprint is replicated to all anchors within covering radius plus threshold that meet
this (at most 68), and every link meets at the home of either end. Comparisons are made per
anchor, in tasks that hold one bucket of anchors. Each anchor reports a spanning forest of
its links, not its pairs: the components are the same and a dense group stays linear.

Cases: null text is empty text; no words give fingerprint zero, which links like any other;
a null id takes part in the links but is never the smallest id (a component of null ids alone
has a null component_id); an empty table gives an empty result; other columns are ignored.
Rows with the same id are judged each by their own text (``keep_one_per_group``).
"""
from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, materialize, texts, width
from .components import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY = 0b101011100011
BLOCK = 23
#: Replicas in one task of the comparison.
REPLICAS_PER_TASK = 4_000_000
#: Anchors with more fingerprints than this look links up by flipping bits instead of comparing all.
SCAN_LIMIT = 20_000


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """SimHash of the ``k``-word shingles, repeats included (the specification, whole texts)."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 18):
        part = words[lo:min(n, lo + (1 << 18)) + k - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
        h = np.array([digest(g, SEED) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})
    return texts(docs).mapInPandas(run, "doc_id long, fp long")


@functools.lru_cache(maxsize=1)
def _golay():
    """Remainders by bit, coset leader by syndrome, and by syndrome the codewords 0, 1 and 2 beyond distance 3."""
    rem = []
    for i in range(BLOCK):
        r = 1 << i
        while r.bit_length() > 11:
            r ^= GOLAY << (r.bit_length() - 12)
        rem.append(r)
    words = np.zeros(1 << 12, np.int64)
    for i in range(12):
        words[(np.arange(1 << 12) >> i & 1) == 1] ^= GOLAY << i
    leader = np.zeros(2048, np.int64)
    for w in range(4):
        for bits in combinations(range(BLOCK), w):
            leader[functools.reduce(int.__xor__, (rem[i] for i in bits), 0)] = sum(1 << i for i in bits)
    far = np.bitwise_count((words[None, :] ^ leader[:, None]).astype(np.uint64)).astype(np.int64)
    tables = []
    for test in (far <= 3, far == 4, far == 5):
        most = int(test.sum(axis=1).max())
        t = np.full((2048, most), -1, np.int64)
        for s in range(2048):
            got = words[test[s]]
            t[s, :len(got)] = got
        tables.append(t)
    return np.array(rem, np.int64), leader, tables


def anchors(fps: np.ndarray):
    """For fingerprints (uint64): replicas as (index of the fingerprint, anchor, is it its home)."""
    rem, leader, tables = _golay()
    near = []
    for lo in (0, BLOCK):
        y = (fps >> np.uint64(lo)).astype(np.int64) & ((1 << BLOCK) - 1)
        s = np.zeros(len(y), np.int64)
        for i in range(BLOCK):
            s ^= np.where(y >> i & 1, rem[i], 0)
        code = y ^ leader[s]
        near.append([np.where(t[s] < 0, -1, t[s] ^ code[:, None]) for t in tables])
    idx, anchor, home = [], [], []
    for f in range(MAX_BITS + 1):
        for g in range(MAX_BITS + 1 - f):
            a, b = near[0][f], near[1][g]
            both = np.where((a[:, :, None] < 0) | (b[:, None, :] < 0), -1, a[:, :, None] << BLOCK | b[:, None, :])
            both = both.reshape(len(fps), -1)
            i, j = np.nonzero(both >= 0)
            idx.append(i)
            anchor.append(both[i, j])
            home.append(np.full(len(i), f == 0 and g == 0))
    return np.concatenate(idx), np.concatenate(anchor), np.concatenate(home)


def _forest(homes: np.ndarray, members: np.ndarray, max_bits: int):
    """Spanning forest of the links between ``homes`` and ``members`` (distinct, sorted; homes are members)."""
    label, out = np.arange(len(members)), []

    def join(me: int, near: np.ndarray):
        labs = np.unique(label[near])
        if len(labs) > 1:
            out.extend((members[x], members[labs[0]]) for x in labs[1:])
            label[np.isin(label, labs[1:])] = labs[0]

    if len(members) <= SCAN_LIMIT:
        for x in homes:
            near = np.flatnonzero(np.bitwise_count(members ^ x) <= max_bits)
            if len(near) > 1:
                join(0, near)
        return out
    # a very dense anchor: look up every flip of up to max_bits bits; linear in the fingerprints
    masks = [functools.reduce(int.__or__, (1 << i for i in c), 0)
             for w in range(1, max_bits + 1) for c in combinations(range(64), w)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for m in masks:
        cand = homes ^ np.uint64(m)
        at = np.minimum(np.searchsorted(members, cand), len(members) - 1)
        for x, y in zip(homes[members[at] == cand].tolist(), cand[members[at] == cand].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((max(x, y), min(x, y)))
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints ``fps(fp)`` to pairs (a, b) that have the same components as all links."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the anchor tables cover distances up to {MAX_BITS}")
    spark = fps.sparkSession
    n_buckets = width(spark, 68 * fps.count(), REPLICAS_PER_TASK)

    def replicate(batches):
        for b in batches:
            for lo in range(0, len(b), 1 << 14):
                fp = b["fp"].to_numpy(np.int64)[lo:lo + (1 << 14)].view(np.uint64)
                i, anchor, home = anchors(fp)
                bucket = (anchor * 0x9E3779B1 >> 13) % n_buckets
                order = np.argsort(bucket, kind="stable")
                i, anchor, home, bucket = i[order], anchor[order], home[order], bucket[order]
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[edges[1:], len(bucket)]
                yield pd.DataFrame({
                    "bucket": bucket[edges],
                    "fps": [fp[i[s:e]].tobytes() for s, e in zip(edges, ends)],
                    "anchors": [(anchor[s:e] << 1 | home[s:e]).tobytes() for s, e in zip(edges, ends)]})

    def compare(pdf):
        fp = np.frombuffer(b"".join(pdf["fps"]), np.uint64)
        tag = np.frombuffer(b"".join(pdf["anchors"]), np.int64)
        order = np.lexsort((fp, tag >> 1))
        fp, anchor, home = fp[order], tag[order] >> 1, (tag[order] & 1).astype(bool)
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        end = np.r_[start[1:], len(anchor)]
        homes = np.add.reduceat(home.astype(np.int64), start)
        out, two = [], (homes == 1) & (end - start == 2)
        first, second = fp[start[two]], fp[start[two] + 1]
        hit = np.bitwise_count(first ^ second) <= max_bits
        out.append(np.stack([first[hit], second[hit]], axis=1))
        for s, e in zip(start[(homes > 0) & (end - start > 1) & ~two], end[(homes > 0) & (end - start > 1) & ~two]):
            got = _forest(fp[s:e][home[s:e]], fp[s:e], max_bits)
            if got:
                out.append(np.array(got, np.uint64))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})

    return (fps.select("fp").mapInPandas(replicate, "bucket long, fps binary, anchors binary")
            .repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: the smallest id reachable over links."""
    fp = materialize(fingerprints(docs, k), "simhash")
    own = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    parts = materialize(components(links(own, max_bits)), "simhash-parts")
    rooted = own.join(parts, own.fp == parts.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.select("fp", "root").join(low, "root").select(
        F.col("fp").alias("key"), "component_id"), "simhash-named")
    return fp.join(named, fp.fp == named.key).select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, all columns: the smallest id (nulls last), then hash of the text.

    Null and repeated ids lose no component. Full ties are broken by a hash of the whole row.
    """
    def make():
        def f(_, text):
            return [np.array([fingerprint(t, k) for t in text], np.uint64).view(np.int64)]
        return f
    rank = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").cast("long").alias("id"),
                    F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_hash"),
                    F.xxhash64(F.to_json("row")).alias("row_hash"))
    # one row for each fingerprint first: copies meet in partial sums, the rest is about distinct texts
    first = materialize(annotate(docs, make, "fp long", keep=True).groupBy("fp").agg(
        F.min(rank).alias("rank"), F.min_by("row", rank).alias("row")), "simhash-first")
    parts = materialize(components(links(first.select("fp"), max_bits)), "simhash-parts")
    best = first.select("fp", "rank").join(parts, F.col("fp") == parts.node, "left").groupBy(
        F.coalesce("root", "fp").alias("root")).agg(F.min_by("fp", "rank").alias("kept"))
    best = materialize(best.select("kept"), "simhash-kept")
    return first.join(best, first.fp == best.kept, "left_semi").select("row.*")


def keep_one(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each id that is the smallest of some group, all columns.

    Decides by id, so groups of null or repeated ids can lose their only row: a filtering stage
    takes ``keep_one_per_group``.
    """
    kept = near_duplicates(docs, k, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialize(kept.select(F.col("doc_id").alias("kept_doc_id")).distinct(), "simhash-kept")
    ids = docs.dropDuplicates(["doc_id"])
    return ids.join(kept, ids["doc_id"].cast("long").eqNullSafe(kept["kept_doc_id"]), "left_semi")
