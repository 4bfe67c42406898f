"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words and one end mark per document; the model is a bigram model smoothed by its
unigram distribution: p(w | v) = (c(v, w) + K * p1(w)) / (c(v) + K) with
p1(w) = (c(w) + 1) / (N + V + 1). The end mark also stands before the first word.

Counts cover all training documents. Every slab of documents sends its distinct words to
buckets of their hash, which add up the counts and number the words, then its distinct pairs,
by these numbers, to buckets of pairs. A bucket of pairs
becomes one shard of the trie: level 1 holds the contexts, pointers give each context's range
in level 2, and level 2 holds successors relative to their context, made monotone by the
context's rank. All three are Elias-Fano coded; each successor has a 16-bit quantised smoothed
log probability. The levels lie in anonymous memory maps of the task, in no file, and are never
decoded whole: the distinct pairs of all documents are looked up in the packed bits, their context by
select on the unary parts, then their word by successor search inside the context's range of pointers.
The codes go back to the slabs, which add them up. A frequent context is spread over all shards, since
pairs are dealt by both words. Word statistics, pairs and answers all grow with the corpus and
stay in tasks; the driver sees N and V only.

Cases: null text is empty text (one token, the end); null ids count as training documents;
repeated rows count each; without training documents every probability is 1 / (V + 1) with V = 0,
so scores are 0; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import mmap
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .slabs import NULL_ID, Slab, bucket_of, cut, deal, each_slab, unzip_bytes, zip_bytes

HELD_OUT, FOLDS, PRIOR, STEP = 2, 7, 300.0, 4000.0


#: Place of the k-th one bit of a byte, by byte and k.
_IN_BYTE = np.argsort(-((np.arange(256)[:, None] >> np.arange(8)) & 1), axis=1, kind="stable").astype(np.int64)


def _select(words: np.ndarray, ones: np.ndarray, k: np.ndarray, flag: int) -> np.ndarray:
    """Place of the k-th (from 0) bit equal to ``flag``; ``ones``: one bits before each 64-bit word."""
    before = ones if flag else (np.arange(len(ones)) << 6) - ones
    w = np.searchsorted(before, k, "right") - 1
    rest = (k - before[w]).astype(np.uint8)
    x = words[w] if flag else ~words[w]
    at = w << 6
    for half in (32, 16, 8):
        low = np.bitwise_count(x & np.uint64((1 << half) - 1))
        right = rest >= low
        rest -= low * right
        x = x >> (right * np.uint64(half))
        at += right * half
    return at + _IN_BYTE[x & np.uint64(255), rest]


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers: packed low bits and unary high parts.

    Both are 64-bit words, with one count of one bits a word; single numbers and successors are found
    by select on the packed bits, without decoding the sequence.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.cumsum(np.r_[0, np.bitwise_count(high[:-1])], dtype=np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        upper = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(upper[-1]) + 1 if n else 0) + 1, np.uint8)  # a zero ends the last part
        flags[upper] = 1
        low = np.zeros((n, bits), np.uint8)
        for i in range(bits):
            low[:, i] = (v >> np.uint64(i)).astype(np.uint8) & 1
        return cls(n, bits, cls._packed(low.reshape(-1)), cls._packed(flags))

    @staticmethod
    def _packed(flags: np.ndarray) -> np.ndarray:
        raw = np.packbits(flags, bitorder="little")
        return np.r_[raw, np.zeros(-len(raw) % 8 + 8, np.uint8)].view("<u8")

    def values(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Numbers ``lo`` to ``hi``, decoded."""
        return self.at(np.arange(lo, self.n if hi is None else hi))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        w, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[w] >> shift | self.low[w + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return out & np.uint64((1 << self.low_bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        high = (_select(self.high, self.ones, i, 1) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def search(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the successor (first number not below) of each of ``x`` within places ``lo`` to ``hi``, and whether it equals."""
        high = x >> np.uint64(self.low_bits)
        parts = np.uint64(len(self.high) * 64 - self.n - 1)  # zeros, with those that fill the last words
        known = np.minimum(high, parts).astype(np.int64)
        ends = _select(self.high, self.ones, known, 0) - known
        start = np.where(known > 0, _select(self.high, self.ones, np.maximum(known - 1, 0), 0) - known + 1, 0)
        start = np.where(high > parts, self.n, start)
        ends = np.maximum(start, np.minimum(ends, self.n))
        if lo is not None:
            start, ends = np.clip(start, lo, hi), np.clip(ends, lo, hi)
        want = x & np.uint64((1 << self.low_bits) - 1)
        stop, live = ends.copy(), np.flatnonzero(start < ends)
        while len(live):  # the numbers with this high part, by their low bits
            mid = (start[live] + stop[live]) >> 1
            less = self._low(mid) < want[live]
            start[live] = np.where(less, mid + 1, start[live])
            stop[live] = np.where(less, stop[live], mid)
            live = live[start[live] < stop[live]]
        equal = start < ends
        equal[equal] = self._low(start[equal]) == want[equal]
        return start, equal


class Trie:
    """Levels of one shard, each in an anonymous memory map, searched as they lie."""

    BLOCK = 1 << 15

    def __init__(self, ctx: np.ndarray, succ: np.ndarray, log10p: np.ndarray):
        """``ctx``, ``succ``: numbers of distinct pairs sorted by both; their log probabilities."""
        level1, start = np.unique(ctx, return_index=True)
        dictionary = np.unique(succ)
        rank = np.repeat(np.arange(len(level1)), np.diff(np.r_[start, len(ctx)]))
        relative = rank.astype(np.uint64) * np.uint64(max(1, len(dictionary))) \
            + np.searchsorted(dictionary, succ).astype(np.uint64)
        code = 1 + np.minimum(65534, np.rint(-log10p * STEP)).astype(np.uint16)
        self.level = {}
        for name, values in (("contexts", level1), ("pointers", np.r_[start, len(ctx)].astype(np.uint64)),
                             ("words", dictionary), ("successors", relative)):
            ef = EliasFano.of(values)
            self.level[name] = EliasFano(ef.n, ef.low_bits, self._map(ef.low), self._map(ef.high))
        self.codes = self._map(code)

    @staticmethod
    def _map(array: np.ndarray) -> np.ndarray:
        if not len(array):
            return array
        pages = mmap.mmap(-1, array.nbytes)
        pages.write(array.tobytes())
        return np.frombuffer(pages, array.dtype)

    def lookup(self, ctx: np.ndarray, succ: np.ndarray) -> np.ndarray:
        """Codes of pairs of word numbers; 0 where the pair is not in the trie."""
        out = np.zeros(len(ctx), np.uint16)
        for lo in range(0, len(ctx), self.BLOCK):
            self._lookup(ctx[lo:lo + self.BLOCK], succ[lo:lo + self.BLOCK], out[lo:lo + self.BLOCK])
        return out

    def _lookup(self, ctx: np.ndarray, succ: np.ndarray, out: np.ndarray) -> None:
        run = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])  # equal contexts in a row are searched once
        r, known = self.level["contexts"].search(ctx[run])
        size = np.diff(np.r_[run, len(ctx)])
        here = np.flatnonzero(np.repeat(known, size))
        size, r = size[known], r[known]
        first, last = (np.repeat(self.level["pointers"].at(x).astype(np.int64), size) for x in (r, r + 1))
        base = np.repeat(r.astype(np.uint64) * np.uint64(max(1, self.level["words"].n)), size)
        w, known = self.level["words"].search(succ[here])
        here = here[known]
        found, hit = self.level["successors"].search(base[known] + w[known].astype(np.uint64), first[known], last[known])
        out[here[hit]] = self.codes[found[hit]]


class Tokens:
    """Tokens of a slab as numbers into its sorted word hashes."""

    def __init__(self, slab: Slab):
        vocab, parts = {b"": 0}, []
        for a, b in zip(slab.starts.tolist(), slab.ends.tolist()):
            parts.append(np.array([vocab.setdefault(w, len(vocab)) for w in slab.data[a:b].lower().split()] + [0], np.int64))
        h = np.array([xxhash.xxh64_intdigest(w) for w in vocab], np.uint64)
        order = np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        self.hash, self.end = h[order], int(place[0])
        self.n = np.array([len(p) for p in parts], np.int64)
        self.tok = place[np.concatenate(parts)] if parts else np.zeros(0, np.int64)
        self.held = np.array([d != NULL_ID and zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in slab.ids.tolist()], bool)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.train = ~self.held[self.doc]

    def pairs(self, n_buckets: int):
        """Distinct pairs by bucket: (context, word, training count), the pair of each token, and the runs."""
        prev = np.r_[self.end, self.tok[:-1]]
        prev[np.cumsum(self.n)[:-1]] = self.end
        key, inv = np.unique(prev * len(self.hash) + self.tok, return_inverse=True)
        ctx, word = key // len(self.hash), key % len(self.hash)
        mixed = (self.hash[ctx] * np.uint64(0x9E3779B97F4A7C15)) ^ (self.hash[word] >> np.uint64(7))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        bucket = bucket_of(mixed ^ (mixed << np.uint64(23)), n_buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        count = np.bincount(inv, self.train, len(key)).astype(np.int64)
        return ctx[order], word[order], count[order], place[inv], cut(bucket[order])


_ANSWER = "slab long, kind int, bucket long, payload binary, n long, v long"


def _payloads(answers: pd.DataFrame, kind: int) -> dict:
    mine = answers[answers["kind"] == kind]
    return {int(b): unzip_bytes(p) for b, p in zip(mine["bucket"], mine["payload"])}


def _known(t: Tokens, answers: pd.DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Training count and number (bucket and rank, in hash order) of each word of the slab, from the word buckets."""
    got = _payloads(answers, 1)
    count, number = [], []
    for b, _, _ in cut(bucket_of(t.hash, n_buckets)):
        c, steps = np.frombuffer(got[b], np.int64).reshape(2, -1)
        count.append(c)
        number.append(np.cumsum(steps) + (b << 32))
    return np.concatenate(count), np.concatenate(number)


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    h = np.frombuffer(b"".join(pdf["hashes"]), np.uint64)
    c = np.frombuffer(b"".join(map(unzip_bytes, pdf["counts"])), np.int64)
    u, inv = np.unique(h, return_inverse=True)
    total = np.bincount(inv, c, len(u)).astype(np.int64)
    size, back = [len(x) // 8 for x in pdf["hashes"]], total[inv]
    ends = np.cumsum(size)
    out = [(s, 1, b, zip_bytes(back[e - k:e].tobytes() + np.diff(inv[e - k:e], prepend=0).astype(np.int64).tobytes()), 0, 0)
           for s, b, e, k in zip(pdf["slab"], pdf["bucket"], ends, size)]
    out.append((-1, 0, int(pdf["bucket"].iloc[0]), b"", int(total.sum()), int((total > 0).sum())))
    return pd.DataFrame(out, columns=["slab", "kind", "bucket", "payload", "n", "v"])


def unigram(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return (c + 1) / (n + v + 1)


def _shard(n_tokens: int, n_words: int, prior: float):
    """Builds a bucket's shard of the trie from the training pairs and answers all pairs of the slabs."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ctx, word, count, c_ctx, c_word, size = [], [], [], [], [], []
        for h, c, i, j, k in zip(pdf["words"], pdf["counts"], pdf["ctx"], pdf["word"], pdf["pairs"]):
            h = np.cumsum(np.frombuffer(unzip_bytes(h), np.int64)).astype(np.uint64)
            c = np.frombuffer(unzip_bytes(c), np.int64)
            i, j = np.cumsum(np.frombuffer(unzip_bytes(i), np.int32)), np.frombuffer(unzip_bytes(j), np.int32)
            ctx.append(h[i]), word.append(h[j]), c_ctx.append(c[i]), c_word.append(c[j])
            count.append(np.frombuffer(unzip_bytes(k), np.int32))
            size.append(len(i))
        ctx, word, c_ctx, c_word = (np.concatenate(x) for x in (ctx, word, c_ctx, c_word))
        count = np.concatenate(count).astype(np.int64)
        order = np.lexsort((word, ctx))
        new = np.r_[True, (ctx[order[1:]] != ctx[order[:-1]]) | (word[order[1:]] != word[order[:-1]])]
        first, total = order[new], np.add.reduceat(count[order], np.flatnonzero(new))
        seen = total > 0
        first, total = first[seen], total[seen]
        p = (total + prior * unigram(c_word[first], n_tokens, n_words)) / (c_ctx[first] + prior)
        distinct = order[new]
        found = Trie(ctx[first], word[first], np.log10(p)).lookup(ctx[distinct], word[distinct])
        codes = np.empty(len(ctx), np.uint16)
        codes[order] = found[np.cumsum(new) - 1]
        ends = np.cumsum(size)
        return pd.DataFrame([(s, 2, b, zip_bytes(codes[e - k:e].tobytes()), 0, 0)
                             for s, b, e, k in zip(pdf["slab"], pdf["bucket"], ends, size)],
                            columns=["slab", "kind", "bucket", "payload", "n", "v"])
    return run


def score(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    table, n = deal(docs)

    def words(slab, _):
        t = Tokens(slab)
        c = np.bincount(t.tok, t.train, len(t.hash)).astype(np.int64)
        return pd.DataFrame([(b, slab.slab, t.hash[s:e].tobytes(), zip_bytes(c[s:e].tobytes()))
                             for b, s, e in cut(bucket_of(t.hash, n))], columns=["bucket", "slab", "hashes", "counts"])

    known = materialize(each_slab(table, words, "bucket long, slab long, hashes binary, counts binary")
                        .groupBy("bucket").applyInPandas(_count_words, _ANSWER), "word-counts")
    n_tokens, n_words = known.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    known = known.where("kind = 1")

    def pairs(slab, answers):
        t = Tokens(slab)
        c, number = _known(t, answers, n)
        ctx, word, count, _, runs = t.pairs(n)
        out = []
        for b, s, e in runs:
            used, at = np.unique(np.r_[ctx[s:e], word[s:e]], return_inverse=True)
            i, j = at[:e - s], at[e - s:]
            out.append((b, slab.slab, zip_bytes(np.diff(number[used], prepend=0).tobytes()), zip_bytes(c[used].tobytes()),
                        zip_bytes(np.diff(i, prepend=0).astype(np.int32).tobytes()),
                        zip_bytes(j.astype(np.int32).tobytes()), zip_bytes(count[s:e].astype(np.int32).tobytes())))
        return pd.DataFrame(out, columns=["bucket", "slab", "words", "counts", "ctx", "word", "pairs"])

    sent = each_slab(table, pairs, "bucket long, slab long, words binary, counts binary, ctx binary, word binary, "
                                   "pairs binary", known)
    codes = sent.groupBy("bucket").applyInPandas(_shard(n_tokens, n_words, prior), _ANSWER)

    def add_up(slab, answers):
        t = Tokens(slab)
        c, _ = _known(t, answers, n)
        ctx, word, _, pair, runs = t.pairs(n)
        got = _payloads(answers, 2)
        code = np.concatenate([np.frombuffer(got[b], np.uint16) for b, _, _ in runs]).astype(np.float64)
        p1 = unigram(c, n_tokens, n_words)
        away = np.log10(prior * p1[word] / (c[ctx] + prior))
        logp = np.where(code > 0, (1 - code) / STEP, away)
        m = len(t.n)
        return pd.DataFrame({
            "doc_id": pd.array([None if d == NULL_ID else d for d in slab.ids.tolist()], "Int64"),
            "held_out": t.held, "n_tokens": t.n,
            "n_known": np.bincount(t.doc, (c > 0)[t.tok], m).astype(np.int64), "train_tokens": n_tokens,
            "base_score": np.bincount(t.doc, np.log10(p1)[t.tok], m), "score": np.bincount(t.doc, logp[pair], m)})

    return each_slab(table, add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                    "base_score double, score double", known.union(codes))
