"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Training (``train``) takes a bounded sample of labelled documents (``TRAIN_DOCS`` of them by
hash order, ``SNIPPETS`` spread pieces of each), and fits two byte-level GRUs and a softmax
at every position by backpropagation through time. Prediction reads whole texts: the bytes
are laid out in blocks, both GRUs label every byte, and a document's probabilities are the
mean over its bytes. The model (a few kilobytes) goes to the tasks; documents are not shuffled.

Cases: null text or text without a letter gives ``und`` with score 0; without any labelled
training row every text is ``und``; an empty table gives an empty result; other columns are
never read by a prediction.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, crc_mod, lowest

TRAIN_DOCS, SNIPPETS, SNIPPET, HIDDEN, STEPS, BATCH, BLOCK = 1500, 4, 64, 8, 110, 256, 128


def _direction(model: dict, d: str, x: np.ndarray, mask=None, keep: list | None = None) -> np.ndarray:
    """States (time, batch, hidden) of one direction over byte columns ``x`` (batch, time)."""
    table, u = model["x" + d], model["u" + d]
    k = u.shape[0]
    h = np.zeros((len(x), k), np.float32)
    out = np.empty((x.shape[1], len(x), k), np.float32)
    for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
        a, b = table[x[:, t]], h @ u
        g = 0.5 + 0.5 * np.tanh(0.5 * (a[:, :2 * k] + b[:, :2 * k]))
        z, r = g[:, :k], g[:, k:]
        c = np.tanh(a[:, 2 * k:] + r * b[:, 2 * k:])
        new = c + z * (h - c)
        if mask is not None:
            new *= mask[:, t, None]
        if keep is not None:
            keep.append((t, h, z, r, c, b[:, 2 * k:]))
        out[t] = h = new
    return out


def _probabilities(model: dict, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    logit = hf @ model["vf"] + hb @ model["vb"] + model["b"]
    e = np.exp(logit - logit.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(model: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Loss and gradients of one batch (bytes ``x``, class ``y``) by backpropagation through time."""
    kept = {"f": [], "b": []}
    states = {d: _direction(model, d, x, keep=kept[d]) for d in "fb"}
    p = _probabilities(model, states["f"], states["b"])
    n, t_len = x.shape
    loss = -(np.log(p[:, np.arange(n), y] + 1e-9) * weight).mean()
    dl = p.copy()
    dl[:, np.arange(n), y] -= 1
    dl *= (weight / (n * t_len))[None, :, None].astype(np.float32)
    grad = {"b": dl.sum(axis=(0, 1))}
    for d in "fb":
        s, u = states[d], model["u" + d]
        k = u.shape[0]
        grad["v" + d] = np.tensordot(s, dl, axes=([0, 1], [0, 1]))
        out = dl @ model["v" + d].T
        gx, gu = np.zeros_like(model["x" + d]), np.zeros_like(u)
        dh = np.zeros((n, k), np.float32)
        for t, h, z, r, c, q in reversed(kept[d]):
            dh = dh + out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * q * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            db = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(gx, x[:, t], da)
            gu += h.T @ db
            dh = dh * z + db @ u.T
        grad["x" + d], grad["u" + d] = gx, gu
    return loss, grad


def train(snippets: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> dict:
    """Fit the network on labelled byte snippets (Adam; classes weigh alike)."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = {"names": names, "b": np.zeros(len(names), np.float32)}
    for d in "fb":
        model["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        model["u" + d] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
        model["v" + d] = rng.normal(0, 0.3, (hidden, len(names))).astype(np.float32)
    if len(names) < 2:
        return model
    x = np.zeros((len(snippets), SNIPPET), np.uint8)
    for i, s in enumerate(snippets):
        piece = (s * (SNIPPET // len(s) + 1))[:SNIPPET]
        x[i] = np.frombuffer(piece, np.uint8)
    y = np.array([names.index(v) for v in labels])
    share = np.bincount(y) / len(y)
    first = {k: np.zeros_like(v) for k, v in model.items() if k != "names"}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(y), min(BATCH, 4 * len(y)))
        w = (1 / (len(names) * share[y[pick]])).astype(np.float32)
        _, grad = gradients(model, x[pick], y[pick], w)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m, v = first[k] / (1 - 0.9 ** step), second[k] / (1 - 0.99 ** step)
            model[k] = (model[k] - 0.02 * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return model


def fit(docs: DataFrame, held_out: int = 2, folds: int = 4) -> dict | None:
    """Train on the documents of the other folds; reads ``TRAIN_DOCS`` labelled rows at most."""
    pool = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()
                      & F.coalesce(crc_mod("doc_id", folds) != held_out, F.lit(True))
                      & F.col("text").rlike(r"\p{L}"))
    cut = [F.substring(F.col("text"), (F.length("text") * (i / SNIPPETS)).cast("int") + 1, F.lit(SNIPPET))
           for i in range(SNIPPETS)]
    hashed = lowest(pool.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.array(*cut).alias("cuts")), "h",
                    TRAIN_DOCS)
    rows = hashed.orderBy("h", "lang").limit(TRAIN_DOCS).collect()
    got = [(s.encode("utf-8", "replace"), r["lang"]) for r in rows for s in r["cuts"] if s]
    return train([s for s, _ in got], [v for _, v in got]) if got else None


def predict(model: dict, texts_: list[str]) -> tuple[list[str], list[float]]:
    """Language and probability of whole texts."""
    names = model["names"]
    # isalpha, not a word pattern: that one also takes fractions and superscripts for letters
    raw = [t.encode("utf-8", "replace") if any(map(str.isalpha, t)) else b"" for t in texts_]
    blocks = np.array([-(-len(r) // BLOCK) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(r.ljust(b * BLOCK, b"\0") for r, b in zip(raw, blocks.tolist())), np.uint8)
    flat = flat.reshape(-1, BLOCK)
    size = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), blocks)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    valid = np.clip(size[owner] - at * BLOCK, 0, BLOCK)
    sums = np.zeros((len(raw), len(names)))
    for lo in range(0, len(flat), 2048):
        x, v = flat[lo:lo + 2048], valid[lo:lo + 2048]
        mask = (np.arange(BLOCK)[None, :] < v[:, None]).astype(np.float32)
        p = _probabilities(model, _direction(model, "f", x), _direction(model, "b", x, mask))
        np.add.at(sums, owner[lo:lo + 2048], np.einsum("tnc,nt->nc", p, mask))
    mean = sums / np.maximum(size, 1)[:, None]
    best = mean.argmax(axis=1)
    return ([names[b] if n else "und" for b, n in zip(best, size)],
            [min(1.0, max(0.0, float(m[b]))) if n else 0.0 for m, b, n in zip(mean, best, size)])


def identify(docs: DataFrame, model: dict | None, keep: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` for every row (``keep``: the whole row is in column ``row``)."""
    def make():
        def f(_, text):
            lang, score = [], []
            for lo in range(0, len(text), 200):
                some = text[lo:lo + 200]
                a, b = predict(model, some) if model else (["und"] * len(some), [0.0] * len(some))
                lang += a
                score += b
            return [lang, score]
        return f
    return annotate(docs, make, "lang_pred string, score double", keep)
