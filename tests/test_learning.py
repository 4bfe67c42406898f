"""Split, scores, vectors, linear classifier and forest: hand cases, a numpy fit, and two layouts."""
import numpy as np
import pytest
from conftest import SF_SMALL

from flowsieve.operators import forest as RF
from flowsieve.operators import learning as L
from flowsieve.plans import learning_queries as Q
from flowsieve.plans import standins as S

ROW = "flow_key string, flow_key_rev string, label string, x int"


def test_no_conversation_in_both_parts(spark):
    out = L.train_test_split(S.f8_classes(spark, SF_SMALL), 0.3).collect()
    parts = {}
    for r in out:
        parts.setdefault(min(r["flow_key"], r["flow_key_rev"]), set()).add(r["part"])
    assert max(len(p) for p in parts.values()) == 1
    share = np.mean([r["part"] == "test" for r in out])
    assert 0.29 < share <= 0.3
    for c in ("high", "low", "mid"):
        assert 0.25 < np.mean([r["part"] == "test" for r in out if r["label"] == c]) < 0.35
    other = L.train_test_split(S.f8_classes(spark, SF_SMALL).repartition(5), 0.3)
    assert sorted(map(tuple, other.select("l_orderkey", "l_linenumber", "l_partkey", "part").collect())) == sorted(
        (r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["part"]) for r in out)


def test_split_of_odd_rows(spark):
    rows = [(None, None, "a", 1), (None, "k", None, 2), ("k", None, None, 3), ("m", "n", "a", 4), ("n", "m", "a", 5)]
    out = L.train_test_split(spark.createDataFrame(rows, ROW), 1.0).collect()
    assert sorted((r["x"], r["part"]) for r in out) == [(1, "train"), (2, "train"), (3, "test"), (4, "test"), (5, "test")]
    assert all(r["part"] == "train" for r in L.train_test_split(spark.createDataFrame(rows, ROW), 0.0).collect())
    assert L.train_test_split(spark.createDataFrame([], ROW)).count() == 0
    with pytest.raises(ValueError):
        L.train_test_split(spark.createDataFrame(rows, ROW), 1.5)


def test_scores_of_odd_predictions(spark):
    rows = [("a", "a"), ("a", None), ("b", "a"), (None, "a"), ("b", "z")]
    got = {(r["kind"], r["class"]): tuple(r)[2:] for r in L.classification_metrics(
        spark.createDataFrame(rows, "label string, prediction string"), zero_division=0.5).collect()}
    assert got["class", "a"] == (0.5, 0.5, 0.5, 2)
    assert got["class", "b"] == (0.5, 0.0, 0.0, 2)     # never predicted: the given precision
    assert got["class", "z"] == (0.0, 0.5, 0.0, 0)     # only predicted: the given recall
    assert got["micro", None] == (round(1 / 3, 6), 0.25, round(2 / 7, 6), 4)
    assert got["weighted", None] == (0.5, 0.25, 0.25, 4)
    assert L.classification_metrics(spark.createDataFrame([], "label string, prediction string")).count() == 0


def test_vectors_stored_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (float("nan"), 5.0, None), (float("inf"), 5.0, None)],
                               "`a.b` double, c double, d double")
    L.fit_vectors(df).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    assert sorted(map(tuple, model.collect())) == [(0, "a.b", 2.0, pytest.approx(2 ** .5)), (1, "c", 5.0, 1.0), (2, "d", 0.0, 1.0)]
    new = spark.createDataFrame([(0.0, None, 2.0), (None, 0.0, float("-inf"))], "`a.b` double, c double, d double")
    got = [tuple(r["features"]) for r in L.to_vectors(new, model).collect()]
    assert got == [(3, [1, 2], [5.0, 2.0]), (3, [0], [pytest.approx(2 ** .5)])]
    centred = [tuple(r["features"]) for r in L.to_vectors(new, model, center=True).collect()]
    assert centred[1] == (3, [1], [-5.0])


def plain_svm(x, y, c):
    """Squared-hinge classifier by damped Newton steps on the whole matrix."""
    w = np.zeros(x.shape[1])
    free = np.r_[np.ones(x.shape[1] - 1), 0]

    def loss(v):
        return 0.5 * free @ v ** 2 + c * (np.maximum(0, 1 - y * (x @ v)) ** 2).mean()
    for _ in range(200):
        gap = np.maximum(0, 1 - y * (x @ w))
        grad = free * w - 2 * c * x.T @ (gap * y) / len(y)
        a = x[gap > 0]
        step = np.linalg.solve(np.diag(free + 1e-12) + 2 * c * a.T @ a / len(y), grad)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * step
    return w, loss(w)


def test_linear_classifier_equals_numpy(spark):
    df = S.f8_classes(spark, SF_SMALL)
    model, losses = L.fit_linear_svm(df.repartition(7), Q.F8_FEATURES, c=2.0)
    rows = df.select(*Q.F8_FEATURES, "label").collect()
    x = np.array([r[:4] for r in rows])
    x = np.c_[(x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.ones(len(x))]
    weights = {}
    for r in model.collect():
        weights.setdefault(r["class"], []).append(r["weight"])
    for c, got in zip(("high", "low", "mid"), losses):
        w, best = plain_svm(x, np.array([1.0 if r["label"] == c else -1.0 for r in rows]), 2.0)
        assert abs(got - best) < 1e-6
        assert np.allclose(weights[c], w, atol=1e-5)
    score = np.array([x @ np.array(weights[c]) for c in ("high", "low", "mid")])
    want = [("high", "low", "mid")[i] for i in score.argmax(axis=0)]
    got = [r["prediction"] for r in L.predict_linear(df, model).collect()]
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.999
    with pytest.raises(ValueError):
        L.fit_linear_svm(df.limit(0), Q.F8_FEATURES)


def test_forest_beats_the_majority_on_held_out_rows(spark):
    out = {(r["kind"], r["class"]): r for r in Q.q_forest_scores(spark, SF_SMALL).collect()}
    n = {c: out["class", c]["support"] for c in ("high", "low", "mid")}
    assert out["micro", None]["recall"] > max(n.values()) / sum(n.values()) + 0.2


def test_forest_same_trees_on_two_layouts(spark):
    df = S.f8_classes(spark, SF_SMALL)
    a = RF.fit_forest(df, Q.F8_FEATURES, trees=3, depth=4)
    b = RF.fit_forest(df.orderBy("p").repartition(5), Q.F8_FEATURES, trees=3, depth=4)
    assert a.collect() == b.collect()
    nodes = {(r["tree"], r["node"]): r for r in a.collect()}
    for (t, i), r in nodes.items():
        assert (r["feature"] is not None) == ((t, 2 * i) in nodes) == ((t, 2 * i + 1) in nodes)
        if r["feature"] is not None:
            assert nodes[t, 2 * i]["n"] + nodes[t, 2 * i + 1]["n"] == r["n"]


def test_one_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(RF, "weights", lambda h, tree, seed: np.ones(len(h), np.int64))
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (300, 2)).astype(float)
    y = np.where(x[:, 0] > 4, "b", np.where(x[:, 1] > 2, "c", "a"))
    rows = [(None if i % 50 == 3 else float(p), float(q), str(c)) for i, ((p, q), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "p double, `q.r` double, label string")
    pdf = [(float("-inf") if p is None else p, q, c) for p, q, c in rows]

    def gini(s):
        return len(s) - sum(sum(r[2] == c for r in s) ** 2 for c in "abc") / max(1, len(s))
    best = max(((gini(pdf) - gini([r for r in pdf if r[f] <= v]) - gini([r for r in pdf if r[f] > v]), -f, -v)
                for f in (0, 1) for v in range(9)))
    model = {r["node"]: r for r in RF.fit_forest(df, trees=1, depth=3, min_leaf=1, per_node=2).collect()}
    assert (model[1]["feature"], model[1]["threshold"]) == (("p", "q.r")[-best[1]], -best[2])
    got = RF.predict_forest(df, spark.createDataFrame(list(model.values()))).collect()
    assert np.mean([r["prediction"] == r["label"] for r in got]) > 0.98


def test_exploration_scans_the_source_once(spark, tmp_path):
    from flowsieve.plans.exploration import explore
    path = str(tmp_path / "features")
    S.f5_features(spark, SF_SMALL).write.parquet(path)
    out = explore(spark.read.parquet(path))
    assert out.inputFiles() and not any(path in f for f in out.inputFiles())  # the reports read the written columns
    assert {r["report"] for r in out.select("report").distinct().collect()} == {
        "rows", "nulls", "classes", "describe", "dispersion", "histogram", "boxplot", "correlation", "information", "top"}


def test_split_orders_only_the_cell_in_which_the_share_ends(spark, monkeypatch):
    """700 conversations of 1 to 4 rows in three strata and 256 cells: the parts are those of one running count."""
    import hashlib

    from flowsieve.operators import learning as LN
    monkeypatch.setattr(LN, "CELL_BYTES", 1)
    convs = {f"k{i:03d}": ("xyz"[i * i % 7 % 3], i % 4 + 1) for i in range(700)}
    df = spark.createDataFrame([(k, c) for k, (c, n) in convs.items() for _ in range(n)], "flow_key string, label string")
    for share in (0.0, 0.2, 1.0):
        want = set()
        for c in "xyz":
            own, upto = [k for k in convs if convs[k][0] == c], 0
            for k in sorted(own, key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest()):
                upto += convs[k][1]
                if upto <= sum(convs[o][1] for o in own) * share:
                    want.add(k)
        parts = LN.train_test_split(df, share).where("part = 'test'").groupBy("flow_key").count().collect()
        assert {r["flow_key"]: r["count"] for r in parts} == {k: convs[k][1] for k in want}


def test_places_of_all_numbers_a_row_can_get():
    """Rows reach open nodes by table lookup; leaves and inner nodes have no place."""
    import numpy as np

    from flowsieve.operators.forest import places, route
    tree = {1: (0, 3), 2: (1, 0)}
    bins = np.array([[0, 0], [0, 5], [9, 0]], np.uint8)
    assert places([4, 5], tree)[route(bins, tree)].tolist() == [0, 1, -1]
    assert places([1], {})[route(bins, {})].tolist() == [0, 0, 0]
