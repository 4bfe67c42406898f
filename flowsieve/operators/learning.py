"""Split, feature vectors, linear classifier and scores of a labelled flow table.

Everything that grows with the table is an aggregate or a shuffle; the driver holds models only, whose size is
given by the number of features and classes.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import with_flow_keys
from ..functions.roles import split_features
from ..session import materialize, ship_package
from .profile import finite

#: More classes than this are no class column but an identifier.
MAX_CLASSES = 1000
#: Leading bytes of the split's hash that make a cell: 65,536 cells.
CELL_BYTES = 2
#: Partial sums of a pass that reach the driver.
FAN = 8


# --- split (T2) ---------------------------------------------------------------------------


def train_test_split(df: DataFrame, test_share: float = 0.2, label: str = "label", seed: int = 42) -> DataFrame:
    """``df`` with ``part`` (train or test); both directions of a conversation are in the same part.

    A conversation is the smaller of ``flow_key`` and ``flow_key_rev``; its stratum is its most frequent label (ties:
    a missing label, then the smallest). In each stratum conversations come in the order of a seeded hash, and those up to which the
    row count stays within ``test_share`` of the stratum's rows are test: the share is missed by less than the one
    conversation that would exceed it. The hash is cut into cells by ``CELL_BYTES``: a stratum's counts per cell tell the cell in which its
    share ends, and only the conversations of that one are put in order. Rows without a key belong to no conversation and are train.
    """
    if not 0 <= test_share <= 1:
        raise ValueError("test_share must be within 0 and 1")
    if "flow_key" not in df.columns:
        df = with_flow_keys(df)
    rev = [F.col("flow_key_rev")] if "flow_key_rev" in df.columns else []
    base = df.withColumn("__conv", F.when(F.col("flow_key").isNotNull(), F.least("flow_key", *rev, F.lit(None).cast("string"))))
    per = (base.where(F.col("__conv").isNotNull()).groupBy("__conv", F.col(f"`{label}`").cast("string").alias("l"))
               .agg(F.count(F.lit(1)).alias("n")))
    convs = per.groupBy("__conv").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "l")).alias("best")).select(
        "__conv", "n", F.coalesce("best.l", F.lit("(no label)")).alias("stratum"))
    h = F.unhex(F.md5(F.concat("__conv", F.lit(f"|{seed}"))))
    convs = materialize(convs.withColumns({"h": h, "cell": F.conv(F.hex(F.substring(h, 1, CELL_BYTES)), 16, 10).cast("int")}), "split-conversations")
    cells = convs.groupBy("stratum", "cell").agg(F.sum("n").alias("c"))
    by = Window.partitionBy("stratum")
    ends = cells.select("stratum", "cell", F.sum("c").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "c",
                        (F.sum("c").over(by) * F.lit(float(test_share))).alias("most"))
    # whole cells up to the share, then the conversations of the cell that would exceed it
    ends = materialize(ends.select("stratum", "cell", "most", (F.col("upto") - F.col("c")).alias("before"), "upto").where(
        F.col("before") <= F.col("most")), "split-cells")
    whole, cut = ends.where("upto <= most").select("stratum", "cell"), ends.where("upto > most")
    order = Window.partitionBy("stratum").orderBy("h", "__conv").rowsBetween(Window.unboundedPreceding, 0)
    rest = convs.join(cut, ["stratum", "cell"]).withColumn("at", F.col("before") + F.sum("n").over(order)).where("at <= most")
    test = materialize(convs.join(whole, ["stratum", "cell"], "left_semi").select("__conv").union(rest.select("__conv")).withColumn(
        "part", F.lit("test")), "split-test")
    return base.drop("part").join(test, "__conv", "left").withColumn("part", F.coalesce("part", F.lit("train"))).drop("__conv")


# --- scores (T3) --------------------------------------------------------------------------


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           zero_division: float = 0.0, digits: int = 6) -> DataFrame:
    """Rows (kind, class, precision, recall, f1, support): each class, and their macro, micro and weighted means.

    From one confusion table (at most classes squared rows). Rows without a label are left out; a missing prediction is a miss
    of its label and counts for no class. A class that is never predicted has no precision, one that only is predicted no
    recall: both are ``zero_division`` then. F1 is 2 hits / (support + predicted), which has no such case.
    """
    cell = materialize(df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("l"), F.col(prediction).cast(
        "string").alias("p")).agg(F.count(F.lit(1)).alias("n")), "confusion")
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    side = cell.select(F.col("l").alias("class"), hit.alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")).union(
        cell.where(F.col("p").isNotNull()).select("p", F.lit(0).cast("long"), F.lit(0).cast("long"), "n"))
    c = side.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("hit", "support", "predicted")])

    def part(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(float(zero_division)))
    c = c.withColumns({"precision": part("hit", "predicted"), "recall": part("hit", "support"),
                       "f1": F.col("hit") * 2.0 / (F.col("support") + F.col("predicted"))})
    scores = ("precision", "recall", "f1")
    one = c.select(F.lit("class").alias("kind"), "class", *scores, "support")

    def mean(kind, *cols):
        return c.agg(*[x.alias(s) for x, s in zip(cols, scores)], F.sum("support").alias("support")).select(
            F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("class"), *scores, "support").where("support IS NOT NULL")
    total = {x: F.sum(x).cast("double") for x in ("hit", "support", "predicted")}
    out = (one.union(mean("macro", *[F.avg(s) for s in scores]))
              .union(mean("micro", F.coalesce(F.try_divide(total["hit"], total["predicted"]), F.lit(float(zero_division))),
                          F.try_divide(total["hit"], total["support"]), total["hit"] * 2 / (total["support"] + total["predicted"])))
              .union(mean("weighted", *[F.try_divide(F.sum(F.col(s) * F.col("support")), F.sum("support")) for s in scores])))
    return out.select("kind", "class", *[F.round(s, digits).alias(s) for s in scores], F.col("support").cast("long").alias("support"))


# --- feature vectors (T1) -----------------------------------------------------------------


def fit_vectors(df: DataFrame, features=None) -> DataFrame:
    """The stored part of the vectors: (position, feature, fill, scale) of every numeric column, in one pass.

    ``fill`` (the mean) replaces null, NaN and infinities; ``scale`` is the sample deviation of what is present, or 1
    where it is 0 or unknown. A column that is always missing is filled with 0.
    """
    feats = list(features) if features else split_features(df)[0]
    v = [finite(F.col(f"`{c}`")) for c in feats]
    wide = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)], *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(v)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.coalesce(f"m{i}", F.lit(0.0)).alias("fill"),
                     F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0).alias("scale")) for i, c in enumerate(feats)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def to_vectors(df: DataFrame, model: DataFrame, out: str = "features", center: bool = False) -> DataFrame:
    """``df`` with a sparse vector: size, indices (ascending, from 0) and values of the entries that are not 0.

    Missing values are filled as fitted, also in columns that had none when fitted. Values are divided by the scale;
    ``center`` subtracts the fill first (then few entries are 0). One row of the model per feature is read by the driver.
    """
    m = model.orderBy("position").collect()
    full = []
    for r in m:
        x = F.coalesce(finite(F.col(f"`{r['feature']}`")), F.lit(r["fill"]))
        full.append((x - F.lit(r["fill"] if center else 0.0)) / F.lit(r["scale"]))
    pairs = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("v")) for i, x in enumerate(full)]), lambda e: e["v"] != 0)
    return df.withColumn(out, pairs).withColumn(out, F.struct(
        F.lit(len(m)).alias("size"), F.col(out)["i"].alias("indices"), F.col(out)["v"].alias("values")))


# --- one-vs-rest linear classifier (T2) ---------------------------------------------------


def _classes(df: DataFrame, label: str) -> list[str]:
    found = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("c")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} values")
    return sorted(r["c"] for r in found)


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays (one row a task) in a tree of two levels; the driver adds ``FAN`` of them."""
    import pyarrow as pa

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
    rows = parts.repartition(FAN).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(r["part"], np.float64) for r in rows), np.zeros(size))


def fit_linear_svm(df: DataFrame, features=None, label: str = "label", c: float = 1.0, max_iter: int = 30,
                   tol: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """One-vs-rest linear classifiers: (class, feature, weight, mean, scale) rows, and the loss per class.

    Per class: |w|^2 / 2 + c * mean(max(0, 1 - y f)^2) over standardised features (missing: the mean), the
    intercept (feature null) not penalised. Newton's method: a pass sums loss, gradient and
    Hessian of all classes in tasks, a second one the losses of eight step lengths; each adds arrays of
    classes * (features + 1)^2 numbers in a tree. Rows without a label are left out.
    """
    import pyarrow as pa

    ship_package(df.sparkSession)
    model = fit_vectors(df.where(F.col(label).isNotNull()), features).orderBy("position").collect()
    names, classes = [r["feature"] for r in model], _classes(df, label)
    fill, scale = np.array([r["fill"] for r in model]), np.array([r["scale"] for r in model])
    k, d = len(classes), len(names) + 1
    rows = materialize(df.where(F.col(label).isNotNull()).select(
        F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(label).cast("string")).cast("int").alias("y"),
        F.array(*[F.coalesce(finite(F.col(f"`{n}`")), F.lit(float(m))) for n, m in zip(names, fill)]).alias("x")), "svm-rows")
    n = rows.count()
    if not n or k < 2:
        raise ValueError("a classifier needs labelled rows of two classes")

    def passed(fn, size):
        def run(batches):
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    x = np.ones((b.num_rows, d))
                    x[:, :-1] = (b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1) - fill) / scale
                    y = np.where(b.column(0).to_numpy(zero_copy_only=False)[:, None] == np.arange(1, k + 1), 1.0, -1.0)
                    total += fn(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
        return _summed(rows.mapInArrow(run, "part binary"), size)

    def moments(w):
        def fn(x, y):
            gap = np.maximum(0, 1 - y * (x @ w.T))
            out = np.empty((k, 1 + d + d * d))
            out[:, 0] = (gap ** 2).sum(axis=0)
            out[:, 1:1 + d] = -2 * ((gap * y).T @ x)
            for i in range(k):
                active = x[gap[:, i] > 0]
                out[i, 1 + d:] = 2 * (active.T @ active).ravel()
            return out.ravel()
        return fn

    def losses(ws):
        def fn(x, y):
            return np.stack([(np.maximum(0, 1 - y * (x @ w.T)) ** 2).sum(axis=0) for w in ws]).ravel()
        return fn

    free = np.ones(d)
    free[-1] = 0  # the intercept's penalty
    w, steps = np.zeros((k, d)), 0.5 ** np.arange(8)
    for _ in range(max_iter):
        s = passed(moments(w), k * (1 + d + d * d)).reshape(k, -1)
        loss = 0.5 * (w ** 2 @ free) + c * s[:, 0] / n
        grad = w * free + c * s[:, 1:1 + d] / n
        hess = c * s[:, 1 + d:].reshape(k, d, d) / n + np.diag(free + 1e-12)
        move = -np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        if (-(grad * move).sum(axis=1) <= tol * np.maximum(1, loss)).all():
            break
        tried = [w + t * move for t in steps]
        got = passed(losses(tried), len(steps) * k).reshape(len(steps), k) * c / n
        got += np.stack([0.5 * (x ** 2 @ free) for x in tried])
        best = got.argmin(axis=0)
        w = np.where((got.min(axis=0) < loss)[:, None], np.stack(tried)[best, np.arange(k)], w)
    out = [(classes[i], names[j] if j < d - 1 else None, float(w[i, j]), float(fill[j]) if j < d - 1 else None,
            float(scale[j]) if j < d - 1 else None) for i in range(k) for j in range(d)]
    return df.sparkSession.createDataFrame(out, "class string, feature string, weight double, mean double, scale double"), loss.tolist()


def predict_linear(df: DataFrame, model: DataFrame, out: str = "prediction") -> DataFrame:
    """``df`` with the class of the highest score (ties: the first by name), as plain column expressions."""
    rows = model.orderBy("class").collect()
    scores = {}
    for r in rows:
        x = F.lit(r["weight"])
        if r["feature"] is not None:
            value = F.coalesce(finite(F.col(f"`{r['feature']}`")), F.lit(r["mean"]))
            x = x * (value - F.lit(r["mean"])) / F.lit(r["scale"])
        scores[r["class"]] = scores[r["class"]] + x if r["class"] in scores else x
    df = df.withColumn("__scores", F.array(*scores.values())).withColumn("__best", F.array_max("__scores"))
    at = F.array_position("__scores", F.col("__best")).cast("int")
    return df.withColumn(out, F.element_at(F.array(*[F.lit(x) for x in scores]), at)).drop("__scores", "__best")
