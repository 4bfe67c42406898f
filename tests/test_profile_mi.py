"""Correlation under ANSI with constant/null columns; k-NN MI against brute force."""
import numpy as np
from pyspark.sql import functions as F

from flowsieve.operators import profile as P
from flowsieve.operators.mutual_info import mutual_information_knn
from flowsieve.plans import standins as S

SF = "/root/testdata/sf0.001"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def test_constant_and_null_columns_do_not_raise(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 1.0, None), (3.0, 1.0, 4.0)], "a double, c double, n double")
    m = {(r.feature_a, r.feature_b): r.r for r in P.correlation_matrix(df, ["a", "c", "n"]).collect()}
    assert m[("a", "a")] == 1.0 and m[("a", "c")] is None and m[("c", "c")] is None
    assert m[("a", "n")] is None           # one pair-complete row: no variance
    d = {r.feature: r for r in P.describe(df, ["a", "c", "n"]).collect()}
    assert d["c"].std == 0.0 and d["n"]["count"] == 1


def _digamma_int(v):
    return np.array([-0.5772156649015329 + sum(1.0 / j for j in range(1, int(z))) for z in np.atleast_1d(v)])


def _mi_brute(x, y, K=3):
    keep = ~np.isnan(x)
    x, y = x[keep], y[keep]
    sel = np.zeros(len(x), bool)
    ks, nc, r = np.zeros(len(x), int), np.zeros(len(x), int), np.zeros(len(x))
    for c in np.unique(y):
        idx = np.where(y == c)[0]
        if len(idx) < 2:
            continue
        k = min(K, len(idx) - 1)
        dd = np.abs(x[idx][:, None] - x[idx][None, :])
        np.fill_diagonal(dd, np.inf)
        r[idx] = np.sort(dd, axis=1)[:, k - 1]
        sel[idx], ks[idx], nc[idx] = True, k, len(idx)
    x2, r2 = x[sel], r[sel]
    m = np.array([(np.abs(x2 - a) < b).sum() if b > 0 else (x2 == a).sum() for a, b in zip(x2, r2)])
    return _digamma_int([len(x2)])[0] + _digamma_int(ks[sel]).mean() - _digamma_int(nc[sel]).mean() \
        - _digamma_int(m).mean()


def test_knn_mi_equals_brute_force(spark):
    li = S.table(spark, "/root/testdata/sf0.001", "lineitem")
    df = li.select(*KEY, F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"),
                   F.when(F.col("l_quantity") > 25, "hi").when(F.col("l_quantity") > 5, "mid")
                    .otherwise(F.col("l_returnflag")).alias("label"))
    got = {r.feature: r.mi for r in mutual_information_knn(df, ["q", "t"], sample_rows=1500, id_cols=KEY,
                                                          clip=False, jitter=False).collect()}
    from flowsieve.operators.sampling import sample_fixed_n
    pdf = sample_fixed_n(df, 1500, 42, KEY).toPandas()
    for f in ("q", "t"):
        assert abs(_mi_brute(pdf[f].to_numpy(float), pdf["label"].to_numpy()) - got[f]) < 1e-6


def test_knn_mi_ranks_dependent_feature_first(spark):
    li = S.table(spark, "/root/testdata/sf0.01", "lineitem")
    df = li.select(*KEY, F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"),
                   F.when(F.col("l_quantity") > 25, "hi").otherwise("lo").alias("label"))
    got = [r.feature for r in mutual_information_knn(df, ["q", "t"], id_cols=KEY).collect()]
    assert got[0] == "q"


def test_knn_mi_is_the_same_on_every_layout(spark, monkeypatch):
    from flowsieve.operators import mutual_info
    monkeypatch.setattr(mutual_info, "BLOCK", 7)       # many blocks and ranges
    li = S.table(spark, SF, "lineitem").select(*KEY, F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"),
                                               F.lit(1.0).alias("const"), F.col("l_returnflag").alias("label"))
    few = [tuple(r) for r in mutual_information_knn(li.coalesce(1), ["q", "t", "const"], id_cols=KEY).collect()]
    many = [tuple(r) for r in mutual_information_knn(li.repartition(8), ["q", "t", "const"], id_cols=KEY).collect()]
    assert few == many and len(few) == 3


def test_knn_information_counts_equal_rows_once(spark, monkeypatch):
    """Values that repeat are one weighted point from the first shuffle on; the result is that of every row by itself."""
    import math

    from flowsieve.operators import mutual_info as MI
    rows = [(i, float([0, 1, 1, 2, 4, 7][i * i % 6] + (i % 97 == 0) * i / 8), "aab"[i % 3]) for i in range(600)] + [(600, 3.0, "alone")]
    seen, sums = [], MI.running_sums

    def watched(df, *a):
        seen.append(df.count())
        return sums(df, *a)
    monkeypatch.setattr(MI, "running_sums", watched)
    got = mutual_information_knn(spark.createDataFrame(rows, "id int, x double, label string"), ["x"], id_cols=["id"], jitter=False,
                                 clip=False).first()["mi"]
    used = [r for r in rows if r[2] != "alone"]
    points = len({r[1:] for r in used})
    assert seen == [points, 3 * points] and points < 60

    def psi(n):
        return sum(1 / i for i in range(1, n)) - 0.5772156649015329
    size = {c: sum(r[2] == c for r in used) for c in "ab"}
    total = psi(len(used))
    for i, x, c in used:
        r = sorted(abs(x - y) for j, y, d in used if d == c and j != i)[2]
        m = sum(abs(x - y) < r or x == y for _, y, _ in used)
        total += (psi(3) - psi(size[c]) - psi(m)) / len(used)
    assert math.isclose(got, total, abs_tol=2e-6)
