"""Random forest grown level by level over bin histograms.

Rows are reduced once to one byte a feature (its bin between exact quantiles), the class number and a hash. For each
level, tasks route their rows through the trees so far (a model of at most trees * 2^depth nodes travels to them),
count (tree, node, feature, bin, class) in arrays and send the cells that are not empty; Spark adds them up, and each
node's best split is found from its own cells, at most features * bins * classes. No row is shuffled.

Bootstrap weights (Poisson 1) and the features tried in a node come from hashes of the row, tree and node, and
counts are integers, so the same rows give the same trees on every layout.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import split_features
from ..session import materialize, ship_package
from .learning import _classes
from .profile import finite
from .quantiles import exact_quantiles

BINS = 32
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
MODEL = "tree int, node int, feature string, threshold double, prediction string, n long, share double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def weights(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) numbers of rows with hashes ``h`` in a tree."""
    x = _mix(h.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) / float(1 << 53), "right")


def tried(tree: int, node: int, n_features: int, per_node: int, seed: int) -> np.ndarray:
    """The features that a node may split on, ascending."""
    x = np.arange(n_features, dtype=np.uint64) + np.uint64((seed << 40) + (tree << 24) + (node << 8) & (1 << 63) - 1)
    return np.sort(np.argsort(_mix(_mix(x)), kind="stable")[:per_node])


def route(bins: np.ndarray, tree: dict) -> np.ndarray:
    """Node number of every row: 1 is the root, 2 i and 2 i + 1 follow i. ``tree``: node -> (feature, last bin on the left)."""
    node = np.ones(len(bins), np.int64)
    top = max(tree, default=0)
    feature, last = np.full(top + 2, -1), np.zeros(top + 2, np.int64)
    for i, (f, b) in tree.items():
        feature[i], last[i] = f, b
    while True:
        inside = np.minimum(node, top + 1)
        move = np.flatnonzero(feature[inside] >= 0)
        if not len(move):
            return node
        f = feature[inside[move]]
        node[move] = 2 * node[move] + (bins[move, f] > last[inside[move]])


def places(nodes: list, tree: dict) -> np.ndarray:
    """For every node number that ``route`` can give its place in ``nodes``, or -1."""
    at = np.full(2 * max(tree, default=0) + 2, -1)
    at[nodes] = np.arange(len(nodes))
    return at


def _gini(c: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity n - sum(c^2) / n of class counts along the last axis."""
    n = c.sum(axis=-1)
    return n - (c.astype(np.float64) ** 2).sum(axis=-1) / np.maximum(n, 1)


def best_split(g: pd.DataFrame, k: int, min_leaf: int) -> pd.DataFrame:
    """The split of one node from its cells (feature, bin, y, w); ties: first feature, then first bin."""
    best = (0.0, -1, -1, None, None)
    for f, c in g.groupby("feature", sort=True):
        hist = np.zeros((int(c["bin"].max()) + 1, k), np.int64)
        hist[c["bin"].to_numpy(), c["y"].to_numpy()] = c["w"].to_numpy()
        left = hist.cumsum(axis=0)
        total = left[-1]
        right = total - left
        gain = _gini(total[None, :])[0] - _gini(left) - _gini(right)
        gain[(left.sum(axis=1) < min_leaf) | (right.sum(axis=1) < min_leaf)] = 0
        b = int(gain.argmax())
        if gain[b] > best[0] + 1e-9:
            best = (float(gain[b]), int(f), b, left[b], right[b])
    counts = g[g["feature"] == g["feature"].min()].groupby("y")["w"].sum()
    own = np.zeros(k, np.int64)
    own[counts.index] = counts
    return pd.DataFrame({"tree": [int(g["tree"].iloc[0])], "node": [int(g["node"].iloc[0])], "feature": [best[1]], "bin": [best[2]],
                         "own": [own.tolist()], "lo": [[] if best[3] is None else best[3].tolist()],
                         "hi": [[] if best[4] is None else best[4].tolist()]})


def fit_forest(df: DataFrame, features=None, label: str = "label", trees: int = 10, depth: int = 6, min_leaf: int = 5,
               per_node: int | None = None, seed: int = 42) -> DataFrame:
    """The model (tree, node, feature, threshold, prediction, n, share), one row a node.

    An inner node sends values up to ``threshold`` and missing ones (null, NaN, infinities) to node 2 i, others to 2 i + 1; a leaf has no feature.
    ``prediction`` is the most frequent class of its (weighted) rows, ties by name, ``share`` its part of them. Rows
    without a label are left out; a node with fewer than 2 * ``min_leaf`` rows or one class is a leaf.
    """
    import pyarrow as pa

    spark = df.sparkSession
    ship_package(spark)
    feats = list(features) if features else split_features(df)[0]
    df = df.where(F.col(label).isNotNull())
    classes = _classes(df, label)
    k, d = len(classes), len(feats)
    if not k or not d:
        raise ValueError("a forest needs labelled rows and a numeric feature")
    if not (1 <= trees <= 1000 and 1 <= depth <= 16):
        raise ValueError("at most 1000 trees of depth 16")
    per_node = per_node or max(1, round(d ** 0.5))
    values = [finite(F.col(f"`{c}`")) for c in feats]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), v.alias("value")) for i, v in enumerate(values)])).alias("e")).select("e.*")
    cuts = exact_quantiles(long, ["f"], [i / BINS for i in range(1, BINS)]).groupBy("f").agg(F.sort_array(F.collect_set("q")).alias("q"))
    edge = {r["f"]: np.array(r["q"]) for r in cuts.collect()}  # at most 31 numbers a feature

    def to_bins(batches):
        for b in batches:
            x = np.zeros((b.num_rows, d), np.uint8)
            for i in range(d):
                v = b.column(i).to_numpy(zero_copy_only=False)
                x[:, i] = np.where(np.isnan(v), 0, np.searchsorted(edge.get(i, np.zeros(0)), v, "left"))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(d), b.column(d + 1)],
                                             names=["bins", "y", "h"])
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")).cast("int") - 1
    rows = materialize(df.select(*[F.coalesce(v, F.lit(float("nan"))).alias(f"v{i}") for i, v in enumerate(values)], code.alias("y"),
                                 F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
                         .mapInArrow(to_bins, "bins binary, y int, h long"), "forest-rows")
    forest: dict = {t: {} for t in range(trees)}
    open_ = {t: [1] for t in range(trees)}
    leaves, inner = {}, {}
    for level in range(depth):
        if not any(open_.values()):
            break

        def cells(batches):
            size = {t: np.zeros(len(nodes) * per_node * BINS * k, np.int64) for t, nodes in open_.items() if nodes}
            subset = {t: np.stack([tried(t, i, d, per_node, seed) for i in open_[t]]) for t in size}
            place = {t: places(open_[t], forest[t]) for t in size}
            for b in batches:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, d)
                y, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                for t in size:
                    at = place[t][route(x, forest[t])]
                    w = weights(h, t, seed)
                    use = np.flatnonzero((at >= 0) & (w > 0))
                    p = at[use]
                    for j in range(per_node):
                        key = ((p * per_node + j) * BINS + x[use, subset[t][p, j]]) * k + y[use]
                        size[t] += np.bincount(key, w[use], len(size[t])).astype(np.int64)
            for t, hist in size.items():
                key = np.flatnonzero(hist)
                p, j = key // (per_node * BINS * k), key // (BINS * k) % per_node
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(key), t, np.int32)), pa.array(np.array(open_[t], np.int32)[p]),
                    pa.array(subset[t][p, j].astype(np.int32)), pa.array((key // k % BINS).astype(np.int32)),
                    pa.array((key % k).astype(np.int32)), pa.array(hist[key])],
                    names=["tree", "node", "feature", "bin", "y", "w"])

        summed = rows.mapInArrow(cells, "tree int, node int, feature int, bin int, y int, w long").groupBy(
            "tree", "node", "feature", "bin", "y").agg(F.sum("w").alias("w"))
        found = summed.groupBy("tree", "node").applyInPandas(
            lambda g: best_split(g, k, min_leaf), "tree int, node int, feature int, bin int, own array<long>, lo array<long>, hi array<long>")
        open_ = {t: [] for t in range(trees)}
        for r in sorted(found.collect()):  # one row for each open node
            own = np.array(r["own"])
            if r["feature"] < 0:
                leaves[r["tree"], r["node"]] = own
                continue
            forest[r["tree"]][r["node"]] = (r["feature"], r["bin"])
            inner[r["tree"], r["node"]] = own
            for child, c in ((2 * r["node"], np.array(r["lo"])), (2 * r["node"] + 1, np.array(r["hi"]))):
                if level + 1 < depth and c.sum() >= 2 * min_leaf and (c > 0).sum() > 1:
                    open_[r["tree"]].append(child)
                else:
                    leaves[r["tree"], child] = c
    out = []
    for (t, i), c in {**inner, **leaves}.items():
        f, b = forest[t].get(i, (None, None))
        out.append((t, i, None if f is None else feats[f], None if f is None else float(edge[f][b]),
                    classes[int(c.argmax())], int(c.sum()), float(c.max() / max(1, c.sum()))))
    return spark.createDataFrame(sorted(out, key=lambda r: r[:2]), MODEL)


def predict_forest(df: DataFrame, model: DataFrame, out: str = "prediction") -> DataFrame:
    """``df`` with the class most trees vote for (ties by name); the model is one row a node."""
    import pyarrow as pa

    ship_package(df.sparkSession)
    nodes = model.collect()
    feats = sorted({r["feature"] for r in nodes if r["feature"] is not None})
    classes = sorted({r["prediction"] for r in nodes})
    by_tree: dict = {}
    for r in nodes:
        by_tree.setdefault(r["tree"], {})[r["node"]] = (feats.index(r["feature"]) if r["feature"] is not None else None,
                                                        r["threshold"], classes.index(r["prediction"]))

    def vote(batches):
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]] or [np.zeros(b.num_rows)], axis=1)
            votes = np.zeros((b.num_rows, len(classes)), np.int64)
            for tree in by_tree.values():
                at = [(1, np.arange(b.num_rows))]
                while at:
                    i, rows = at.pop()
                    f, threshold, c = tree[i]
                    if f is None:
                        votes[rows, c] += 1
                    else:
                        right = x[rows, f] > threshold  # NaN goes left
                        at += [(2 * i, rows[~right]), (2 * i + 1, rows[right])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([classes[i] for i in votes.argmax(axis=1)])], names=["row", "p"])
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[F.coalesce(finite(F.col(f"`{c}`")), F.lit(float("nan"))).alias(f"v{i}") for i, c in enumerate(feats)])
    voted = base.mapInArrow(vote, T.StructType([base.schema["row"], T.StructField("p", T.StringType())]))
    return voted.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out], F.col("p").alias(out))
