"""Feature profiling: describe, dispersion, correlation, histogram, box plot,
mutual information (A10, A11, A14-A18, A22, C26).

All statistics are computed by Spark aggregates over the whole table. Wide
inputs are handled by chunking expressions (code-generation limits) and by
unpivoting to ``(feature, value)`` so one ``groupBy(feature)`` serves every
column. Floating results are rounded to ``digits`` (default 6) for stable
comparison.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import split_features
from ..session import materialize, ship_package
from .quantiles import MAX_EXACT, quantile_columns
from .ranks import running_sums

DIGITS = 6


def _num(df: DataFrame, features=None) -> list[str]:
    return list(features) if features else split_features(df)[0]


def finite(c):
    """The value as double; NaN and infinities are missing."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def unpivot_features(df: DataFrame, features=None, ids=(), drop_null: bool = False) -> DataFrame:
    """Wide -> long ``(ids..., feature, value)`` with values as double, NaN as null."""
    feats = _num(df, features)
    ids = [F.col(f"`{c}`") for c in ids]  # names may have dots: a repeated header gives "name.1"
    cast = df.select(*ids, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c)
                             for c in feats])
    long = cast.unpivot(ids, [F.col(f"`{c}`") for c in feats], "feature", "value")
    return long.where(F.col("value").isNotNull()) if drop_null else long


def describe(df: DataFrame, features=None, exact: bool = True, accuracy: int = 100_000,
             digits: int = DIGITS, max_exact: int = MAX_EXACT) -> DataFrame:
    """count, mean, std (n-1), min, quartiles, max per feature, one row each (A10).

    ``exact=True``: linear-interpolated quartiles by distributed selection
    (:mod:`.quantiles`, bounded memory per task). ``exact=False``: one pass of
    ``percentile_approx`` sketches.
    """
    # nulls are kept: count/avg/min/max skip them, and an all-null feature still gets a row
    long = unpivot_features(df, features)
    v = F.col("value")
    agg = long.groupBy("feature").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        *([] if exact else [F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("qs")]))
    if exact:
        qt = quantile_columns(long, ["feature"], [0.25, 0.5, 0.75], ["q1", "q2", "q3"], max_exact=max_exact)
        agg = (agg.join(qt, "feature", "left")
                  .withColumn("qs", F.array("q1", "q2", "q3")).drop("q1", "q2", "q3"))
    r = lambda c: F.round(c, digits)
    return agg.select("feature", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                      r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
                      r(F.col("min")).alias("min"), r(F.col("qs")[0]).alias("q25"),
                      r(F.col("qs")[1]).alias("q50"), r(F.col("qs")[2]).alias("q75"),
                      r(F.col("max")).alias("max"))


def dispersion(df: DataFrame, features=None, digits: int = DIGITS) -> DataFrame:
    """Coefficient of variation std/mean, largest first.

    mean = 0: inf when std > 0, null when std = 0; ``cv_reliable`` marks
    ``|mean| >= 0.01`` (smaller means make the ratio meaningless).
    """
    long = unpivot_features(df, features, drop_null=True)
    agg = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    cv = (F.when(F.col("mean") != 0, F.col("std") / F.col("mean"))
           .when(F.col("std") > 0, F.lit(float("inf"))))
    return (agg.select("feature", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
                       F.round(cv, digits).alias("cv"), (F.abs("mean") >= 0.01).alias("cv_reliable"))
               .orderBy(F.col("cv").desc_nulls_last()))


def _pair_moments(df: DataFrame, feats: list[str]) -> DataFrame:
    """Pairwise-complete moment sums per feature pair, in one scan.

    Each task multiplies its Arrow batches as matrices (numpy): with ``X`` the
    values (null -> 0, shifted by the column means) and ``M`` the presence mask,
    ``M'M`` counts pair-complete rows, ``X'M`` and ``(X*X)'M`` give the sums of
    one feature over the rows where the other is present, and ``X'X`` the cross
    sums. Tasks emit one row per pair; a ``groupBy(pair)`` adds them up. The
    shift (one cheap aggregate first) keeps the raw sums well conditioned.
    """
    import numpy as np
    import pandas as pd

    ship_package(df.sparkSession)
    k = len(feats)
    vals = df.select(*[finite(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(feats)])
    means = vals.agg(*[F.avg(f"f{i}").alias(f"f{i}") for i in range(k)]).first()
    shift = np.array([0.0 if means[i] is None else float(means[i]) for i in range(k)])
    iu, ju = np.triu_indices(k)

    def moments(batches):
        acc = None
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64") - shift
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype("float64")
            part = (mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0)
            acc = part if acc is None else tuple(a + b for a, b in zip(acc, part))
        if acc is None:
            return
        n, sa, saa, sab = acc
        yield pd.DataFrame({"i": iu, "j": ju, "n": n[iu, ju], "sa": sa[iu, ju], "sb": sa[ju, iu],
                            "saa": saa[iu, ju], "sbb": saa[ju, iu], "sab": sab[iu, ju]})

    schema = "i long, j long, n double, sa double, sb double, saa double, sbb double, sab double"
    sums = (vals.mapInPandas(moments, schema).groupBy("i", "j")
                .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]))
    names = F.array(*[F.lit(c) for c in feats])
    return sums.select(F.element_at(names, F.col("i").cast("int") + 1).alias("feature_a"),
                       F.element_at(names, F.col("j").cast("int") + 1).alias("feature_b"),
                       "n", "sa", "sb", "saa", "sbb", "sab")


def correlation_matrix(df: DataFrame, features=None, upper_only: bool = False,
                       digits: int = DIGITS) -> DataFrame:
    """Pearson r for feature pairs over pairwise-complete rows.

    A zero variance gives null (never a division error). Rows: ``feature_a,
    feature_b, r`` (``a <= b`` in column order when ``upper_only``, else both
    orders and the diagonal).
    """
    feats = _num(df, features)
    s = _pair_moments(df, feats)
    n = F.col("n")
    def mean(c):  # null for a pair that is never present together
        return F.try_divide(F.col(c), n)
    cov = mean("sab") - mean("sa") * mean("sb")
    va = mean("saa") - mean("sa") * mean("sa")
    vb = mean("sbb") - mean("sb") * mean("sb")
    # relative guard: a variance at rounding-noise level is a constant column
    eps = 1e-12
    ok = (n > 0) & (va > eps * mean("saa")) & (vb > eps * mean("sbb"))
    r = F.when(ok, F.try_divide(cov, F.sqrt(va * vb)))
    r = F.when(r > 1.0, 1.0).when(r < -1.0, -1.0).otherwise(r)
    out = s.select("feature_a", "feature_b", F.round(r, digits).alias("r"))
    if upper_only:
        return out
    mirror = out.where(F.col("feature_a") != F.col("feature_b")).select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r")
    return out.unionByName(mirror)


def high_correlation_pairs(df: DataFrame, features=None, threshold: float = 0.9,
                           digits: int = DIGITS) -> DataFrame:
    """Pairs a < b (column order) with |r| >= threshold, strongest first."""
    m = correlation_matrix(df, features, upper_only=True, digits=digits)
    return (m.where(F.col("feature_a") != F.col("feature_b"))
             .withColumn("abs_r", F.abs("r"))
             .where(F.col("abs_r") >= threshold)
             .orderBy(F.col("abs_r").desc(), "feature_a", "feature_b"))


def _binned(df: DataFrame, features, bins: int, log: bool, by_label: bool, label: str):
    if not 1 <= bins:
        raise ValueError("bins must be >= 1")
    ids = [label] if by_label else []
    long = unpivot_features(df, features, ids=ids, drop_null=True).where(F.abs("value") != float("inf"))
    if log:
        long = long.withColumn("value", F.log1p("value"))
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # one row per feature (bounded by the schema): the long table is not shuffled for two numbers
    j = long.join(F.broadcast(rng), "feature")
    raw = F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.lit(bins), raw.cast("int")))
    return j.withColumn("bin", b.cast("int")), ids


def histogram(df: DataFrame, features=None, bins: int = 25, log: bool = False,
              by_label: bool = False, label: str = "label", digits: int = DIGITS) -> DataFrame:
    """Equal-width histogram per feature over [min, max].

    ``bin`` is 1..bins (the maximum falls in the last bin); ``log`` applies
    ln(1+x) first; ``by_label`` splits counts by class.
    """
    j, ids = _binned(df, features, bins, log, by_label, label)
    width = (F.col("hi") - F.col("lo")) / bins
    out = j.groupBy("feature", *ids, "bin").agg(F.count(F.lit(1)).alias("n"),
                                                F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return out.select("feature", *ids, "bin",
                      F.round(F.col("lo") + (F.col("bin") - 1) * width, digits).alias("bin_lo"),
                      F.round(F.col("lo") + F.col("bin") * width, digits).alias("bin_hi"), "n")


def boxplot_stats(df: DataFrame, features=None, by_label: bool = False, label: str = "label",
                  digits: int = DIGITS, max_exact: int = MAX_EXACT) -> DataFrame:
    """Quartiles, 1.5-IQR fences, whiskers (extreme values inside the fences) and
    outlier counts per feature, optionally per class (A18)."""
    ids = [label] if by_label else []
    long = unpivot_features(df, features, ids=ids, drop_null=True)
    keys = ["feature", *ids]
    # one row per group, used twice below: written once so the quantile plan runs once
    q = materialize(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                              .join(quantile_columns(long, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                                                     max_exact=max_exact), keys),
                          "boxplot-quartiles")
    q = q.withColumns({"iqr": F.col("q3") - F.col("q1")})
    q = q.withColumns({"lower_fence": F.col("q1") - 1.5 * F.col("iqr"),
                       "upper_fence": F.col("q3") + 1.5 * F.col("iqr")})
    w = long.join(q.select(*keys, "lower_fence", "upper_fence"), keys)
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    ext = w.groupBy(*keys).agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
                               F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                               F.count(F.when(~inside, 1)).alias("n_outliers"))
    r = lambda c: F.round(F.col(c), digits)
    return q.join(ext, keys).select(*keys, "n", r("q1").alias("q1"), r("median").alias("median"),
                                    r("q3").alias("q3"), r("iqr").alias("iqr"),
                                    r("lower_fence").alias("lower_fence"), r("upper_fence").alias("upper_fence"),
                                    r("whisker_low").alias("whisker_low"), r("whisker_high").alias("whisker_high"),
                                    "n_outliers")


def label_encode(df: DataFrame, label: str = "label", out: str = "label_code") -> DataFrame:
    """Sorted distinct classes -> 0..k-1, joined back to every row.

    Distinct class names are ranked over range partitions, so many classes need no single task.
    The codes are written, which makes both join sides plain exchanges: AQE can split a hot class.
    """
    classes = df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("__one", F.lit(1))
    codes = running_sums(classes, [], [label], "__one", "label-order").select(
        label, (F.col("upto") - 1).cast("bigint").alias(out))
    return df.join(materialize(codes, "label-codes"), label, "left")


def mutual_information_binned(df: DataFrame, features=None, label: str = "label", bins: int = 25,
                              digits: int = DIGITS) -> DataFrame:
    """Plug-in mutual information (nats) between each binned feature and the class
    over all rows with both present, largest first (A16b)."""
    j, _ = _binned(df, features, bins, False, True, label)
    j = j.where(F.col(label).isNotNull())
    # features x bins x classes rows, read by four branches: written once
    cell = materialize(j.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("n_bl")),
                             "mi-cells")
    per_f = cell.groupBy("feature").agg(F.sum("n_bl").alias("n"))
    per_b = cell.groupBy("feature", "bin").agg(F.sum("n_bl").alias("n_b"))
    per_l = cell.groupBy("feature", label).agg(F.sum("n_bl").alias("n_l"))
    t = cell.join(per_f, "feature").join(per_b, ["feature", "bin"]).join(per_l, ["feature", label])
    d = lambda c: F.col(c).cast("double")  # noqa: E731  (products of counts overflow bigint)
    term = (d("n_bl") / d("n")) * F.log(d("n_bl") * d("n") / (d("n_b") * d("n_l")))
    return (t.groupBy("feature").agg(F.sum(term).alias("mi"))
             .select("feature", F.round(F.greatest(F.col("mi"), F.lit(0.0)), digits).alias("mi"))
             .orderBy(F.col("mi").desc_nulls_last(), "feature"))
