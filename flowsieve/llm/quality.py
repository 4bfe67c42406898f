"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating's grade is 0 (toxic), 1 (not toxic, low quality) or 2 (not toxic, good). One weight
vector over hashed words is shared by all grades, with ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - w.x). It gives the expected grade, the tail
probabilities P(grade >= 1) and P(grade >= 2), and ``keep`` = P(grade >= 1) above a cut
chosen on a validation part of the sample.

The fit reads a bounded sample: the first ``TRAIN_ROWS`` usable ratings by hash order (all of
them below that), joined to one document each; words are hashed on the executors and only the
``TRAIN_WORDS`` smallest buckets of a document's words reach the driver, so it never receives more than
TRAIN_ROWS * (4 * TRAIN_WORDS + 24) bytes, whatever the lengths and however often an id is repeated.
Prediction reads whole texts without a shuffle; the model's size is fixed.

Cases: null text is empty text (the thresholds alone decide); ratings with a null id, null
grade or no document are not used; repeated ratings count each; of documents with one id the fit reads the
one with the smallest text hash; without ratings every
document has the middle grade and is kept; empty tables give an empty result; other columns
are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, crc_mod, lowest, texts

TRAIN_ROWS, TRAIN_WORDS, BITS, GRADES, EPOCHS, LEAST_DOCS = 8000, 8192, 20, 3, 10, 10
HELD_OUT, FOLDS = 2, 5
#: Word weights count less in long texts by this power of their distinct words; ridge penalty; learning rate.
POWER, L2, RATE = 0.25, 1e-3, 0.3
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets(text: str) -> np.ndarray:
    """Distinct hashed words of a whole text."""
    crc, mask = zlib.crc32, (1 << BITS) - 1
    ws = set(_WORD.findall(text.encode("utf-8", "replace").lower()))
    return np.unique(np.fromiter((crc(w) & mask for w in ws), np.int64, len(ws)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[np.ndarray], grades: np.ndarray, seed: int = 5) -> dict:
    """Cumulative-link regression by AdaGrad; a fifth of the rows chooses the cut."""
    rng = np.random.default_rng(seed)
    n_docs = Counter(int(f) for r in rows for f in r)
    known = np.zeros(1 << BITS, bool)
    known[[f for f, c in n_docs.items() if c >= LEAST_DOCS]] = True
    rows = [r[known[r]] for r in rows]
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    theta, seen_t = np.array([-1.5, 0.0]), np.full(GRADES - 1, 1e-3)
    valid = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~valid)
    share = np.bincount(grades[fit], minlength=GRADES) / max(1, len(fit))
    weight = np.minimum(5.0, 1 / (GRADES * np.maximum(share, 1e-3)))
    for _ in range(EPOCHS):
        for lo in range(0, len(fit), 64):
            pick = rng.permutation(fit)[:64] if len(fit) <= 64 else fit[lo:lo + 64]
            idx = np.concatenate([rows[i] for i in pick])
            size = np.array([len(rows[i]) for i in pick])
            who = np.repeat(np.arange(len(pick)), size)
            scale = np.maximum(size, 1.0) ** -POWER
            s = np.bincount(who, w[idx], len(pick)) * scale
            y = grades[pick]
            low = np.where(y > 0, theta[np.maximum(y - 1, 0)] - s, -40.0)
            up = np.where(y < GRADES - 1, theta[np.minimum(y, GRADES - 2)] - s, 40.0)
            a, b = _sigmoid(up), _sigmoid(low)
            p = np.maximum(a - b, 1e-9)
            gu, gl = -a * (1 - a) / p * weight[y], b * (1 - b) / p * weight[y]  # d loss / d upper, lower
            gs = -(gu + gl) * scale
            g = np.bincount(idx, gs[who], 1 << BITS) if len(idx) > 1 << 17 else None
            at = np.unique(idx)
            gw = (g[at] if g is not None else
                  np.bincount(np.searchsorted(at, idx), gs[who], len(at))) / len(pick) + L2 * w[at]
            seen[at] += gw * gw
            w[at] -= RATE * gw / np.sqrt(seen[at])
            gt = np.array([(gu[(y == k)].sum() + gl[(y == k + 1)].sum()) / len(pick) for k in range(GRADES - 1)])
            seen_t += gt * gt
            theta = np.sort(theta - 0.1 * gt / np.sqrt(seen_t))
    model = {"w": w.astype(np.float32), "known": np.packbits(known), "theta": theta, "cut": 0.5}
    judge = np.flatnonzero(valid) if valid.any() else fit
    if len(judge):
        p = np.array([score(model, rows[i])[1] for i in judge])
        bad, best = grades[judge] == 0, -1.0
        for cut in np.quantile(p, np.linspace(0.005, 0.6, 120)) if bad.any() else []:
            hit = p < cut
            f1 = 2 * (hit & bad).sum() / max(1, hit.sum() + bad.sum())
            if f1 > best:
                best, model["cut"] = f1, float(cut)
        if not bad.any():
            model["cut"] = 0.0
    return model


def score(model: dict, row: np.ndarray) -> tuple[float, float, float]:
    """Expected grade, P(grade >= 1) and P(grade >= 2) for known hashed words."""
    s = float(model["w"][row].sum()) * max(1.0, len(row)) ** -POWER
    tail = 1 - _sigmoid(model["theta"] - s)
    return float(tail.sum()), float(tail[0]), float(tail[1])


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model from the ratings of documents outside the held-out fold (at most ``TRAIN_ROWS``)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    rated = labels.where("doc_id is not null and toxic is not null and quality is not null") \
        .where(crc_mod("doc_id", FOLDS) != HELD_OUT).select(F.col("doc_id").cast("long").alias("rated_id"),
                                                            grade.alias("grade"))
    hashed = lowest(rated.withColumn("h", F.xxhash64("rated_id")), "h", TRAIN_ROWS)
    some = [(r[0], r[1]) for r in hashed.orderBy("h", "rated_id", "grade").limit(TRAIN_ROWS)
            .select("rated_id", "grade").collect()]
    words = _sampled_words(docs, sorted({i for i, _ in some}))
    got = sorted((zlib.crc32(str(i).encode()), i, g) for i, g in some if i in words)
    return train([words[i] for _, i, _ in got], np.array([g for _, _, g in got])) if got else None


def _sampled_words(docs: DataFrame, wanted: list[int]) -> dict[int, np.ndarray]:
    """Hashed words, at most ``TRAIN_WORDS``, of one document of each id of ``wanted`` that has one."""
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], "rated_id long")
    used = texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("rated_id")) \
        .select("doc_id", "text", F.xxhash64("text").alias("key"))

    def make(batches):
        import pandas as pd
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"],
                                "words": [buckets(t)[:TRAIN_WORDS].astype("<u4").tobytes() for t in b["text"]]})
    one = used.mapInPandas(make, "doc_id long, key long, words binary").groupBy("doc_id").agg(F.min_by("words", "key").alias("words"))
    return {r["doc_id"]: np.frombuffer(r["words"], "<u4").astype(np.int64) for r in one.collect()}


def grade(docs: DataFrame, model: dict | None, keep: bool = False) -> DataFrame:
    """expected_grade, p_keep, p_top and keep for every row of ``docs``."""
    def make():
        known = np.unpackbits(model["known"]).astype(bool) if model else None

        def f(_, text):
            if not model:
                n = len(text)
                return [[1.0] * n, [1.0] * n, [0.0] * n, [True] * n]
            rows = (buckets(t) for t in text)
            got = [score(model, r[known[r]]) for r in rows]
            return [[g[0] for g in got], [g[1] for g in got], [g[2] for g in got],
                    [g[1] >= model["cut"] for g in got]]
        return f
    return annotate(docs, make, "expected_grade double, p_keep double, p_top double, keep boolean", keep)
