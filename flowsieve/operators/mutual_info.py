"""Mutual information between each continuous feature and the class, k-nearest-
neighbour estimator for a discrete target (A16a; Ross 2014, PLoS ONE 9(2)).

For rows of classes with at least two rows (``N`` of them): ``k = min(K, n_class-1)``,
``r`` = distance to the k-th nearest row of the same class, ``m`` = rows of any
class strictly closer than ``r`` (self included; when ``r = 0``, the rows equal
to ``x``). ``MI = max(0, psi(N) + mean psi(k) - mean psi(n_class) - mean psi(m))``.

Spark plan, all features in one job: the data is unpivoted and counted at once per point ``(feature, class, x)``
(map-side sums), so equal values are one weighted row from there on.
Ranks come from range partitions (``running_sums``): a running sum inside each range plus the
totals of the ranges before it, so no task holds a whole feature or class. ``r`` comes from ``lag``/``lead`` over
the points in blocks of ``BLOCK`` places of a class, each with the ``K`` points beside it (in one dimension the k nearest
neighbours form a contiguous run); ``m`` from one cumulative count per feature over points merged
with the two probe rows ``x - r`` and ``x + r``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .profile import unpivot_features
from .ranks import running_sums
from .sampling import _part, sample_fixed_n

#: Points of a class in one window.
BLOCK = 65_536


def digamma(c: Column) -> Column:
    """psi(x) for x >= 1 as a column: shift by 6 with the recurrence, then the
    asymptotic series (error below 1e-12)."""
    x = c.cast("double")
    shift = sum((F.lit(1.0) / (x + i) for i in range(6)), F.lit(0.0))
    y = x + 6
    y2 = y * y
    series = (F.log(y) - F.lit(0.5) / y - F.lit(1 / 12) / y2 + F.lit(1 / 120) / (y2 * y2)
              - F.lit(1 / 252) / (y2 * y2 * y2) + F.lit(1 / 240) / (y2 * y2 * y2 * y2))
    return series - shift


def _jitter(long: DataFrame, seed: int) -> DataFrame:
    # one aggregate gives both the scale and mean|x / sd| = mean|x| / sd; single precision, so that
    # the last bits of a sum, which follow the order of its terms, don't reach the values
    def short(c):
        return c.cast("float").cast("double")
    stats = long.groupBy("feature").agg(short(F.stddev_pop("x")).alias("sd"), short(F.avg(F.abs("x"))).alias("mabs"))
    sd_ok = F.col("sd") > 0
    h1 = F.xxhash64("__row", "feature", F.lit(seed), F.lit(1))
    h2 = F.xxhash64("__row", "feature", F.lit(seed), F.lit(2))
    u1 = (F.pmod(h1, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    u2 = (F.pmod(h2, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)   # Box-Muller
    x = F.when(sd_ok, F.col("x") / F.col("sd")).otherwise(F.col("x"))
    mabs = F.when(sd_ok, F.col("mabs") / F.col("sd")).otherwise(F.col("mabs"))
    return (long.join(stats, "feature")
                .withColumn("x", x + F.lit(1e-10) * F.greatest(F.lit(1.0), mabs) * z)
                .drop("sd", "mabs"))


def _kth_distance(k: Column, k_max: int) -> Column:
    """Distance to the k-th nearest other row of the class from lag/lead over its points: the smallest reach of a run of
    i points on the left and j on the right that holds k rows besides the row itself."""
    x, best = F.col("x"), F.lit(None).cast("double")

    def side(name, i):
        """Rows of the i nearest points on one side."""
        return sum((F.coalesce(f"{name}_w{j}", F.lit(0)) for j in range(1, i + 1)), F.lit(0))
    for i in range(k_max + 1):
        for j in range(k_max + 1 - i):
            left = x - F.col(f"lag_x{i}") if i else F.lit(0.0)
            right = F.col(f"lead_x{j}") - x if j else F.lit(0.0)
            there = (F.col(f"lag_x{i}").isNotNull() if i else F.lit(True)) & (F.col(f"lead_x{j}").isNotNull() if j else F.lit(True))
            enough = F.col("w") - 1 + side("lag", i) + side("lead", j) >= k
            best = F.least(best, F.when(there & enough, F.greatest(left, right)))
    return best


def mutual_information_knn(df: DataFrame, features=None, label: str = "label", n_neighbors: int = 3,
                           sample_rows: int | None = None, seed: int = 42, id_cols=None,
                           digits: int = 6, clip: bool = True, jitter: bool = True) -> DataFrame:
    """``feature, mi`` (nats), largest first, over all rows; ``sample_rows`` takes a seeded sample first.

    Null, NaN and infinite values are missing, as in the correlation: the row does not count for that feature.

    ``jitter`` (default on, as in the common library estimator): each feature is
    divided by its standard deviation (ddof 0; constant features stay as they
    are) and tiny noise ``1e-10 * max(1, mean|x|) * z`` is added so ties do not
    dominate; ``z`` is a standard normal drawn from a hash of the row key
    (``id_cols``, unique), feature and seed, so results do not depend on the layout.
    """
    if not id_cols:
        raise ValueError("id_cols (a unique row key) are needed for a reproducible result")
    if sample_rows is not None:
        df = sample_fixed_n(df, sample_rows, seed, id_cols)
    df = df.withColumn("__row", F.concat(*[_part(c) for c in id_cols]))
    long = (unpivot_features(df, features, ids=[label, "__row"], drop_null=True)
            .where(F.col(label).isNotNull() & (F.abs("value") != float("inf")))
            .select("feature", F.col(label).alias("cls"), F.col("value").alias("x"), "__row"))
    if jitter:
        long = _jitter(long, seed)
    k_max = n_neighbors
    # equal rows of a class have the same neighbours: one point with their number
    points = materialize(long.groupBy("feature", "cls", "x").agg(F.count(F.lit(1)).alias("w")), "mi-points")
    n_cls = points.groupBy("feature", "cls").agg(F.sum("w").alias("n_cls")).where(F.col("n_cls") >= 2)
    ranked = (running_sums(points.join(n_cls, ["feature", "cls"]).withColumn("one", F.lit(1)), ["feature", "cls"], ["x"], "one", "mi-classes")
              .withColumnRenamed("upto", "pos").drop("total"))
    # a block also holds the points at most k_max places outside it
    at = [F.floor((F.col("pos") + d) / BLOCK) for d in (-k_max, 0, k_max)]
    blocks = ranked.withColumn("blk", F.explode(F.array_distinct(F.array(*at))))
    wo = Window.partitionBy("feature", "cls", "blk").orderBy("pos")
    near = {f"{side}_{c}{j}": fn(c, j).over(wo) for side, fn in (("lag", F.lag), ("lead", F.lead)) for c in ("x", "w") for j in range(1, k_max + 1)}
    d = blocks.withColumns(near).where(F.col("blk") == at[1])
    d = d.withColumn("k", F.least(F.lit(k_max), F.col("n_cls") - 1))
    d = d.withColumn("r", _kth_distance(F.col("k"), k_max))
    # m: data rows strictly inside (x - r, x + r); r = 0 -> rows equal to x. Of rows of
    # equal value, tb = -1 probes come before the data ("< v"), +1 probes after them ("<= v").
    zero, x = F.col("r") == 0, F.col("x")

    def row(v, tb, rows, sign):
        return F.struct(v.alias("v"), tb.alias("tb"), rows.cast("long").alias("rows"), F.lit(sign).alias("sign"))
    merged = d.select("feature", "k", "n_cls", "cls", "pos", "w", F.explode(F.array(
        row(x, F.lit(0), F.col("w"), 0),
        row(x + F.col("r"), F.when(zero, 1).otherwise(-1), F.lit(0), 1),
        row(x - F.col("r"), F.when(zero, -1).otherwise(1), F.lit(0), -1))).alias("p")).select(
            "feature", "k", "n_cls", "cls", "pos", "w", "p.*")
    probes = running_sums(merged, ["feature"], ["v", "tb", "cls", "pos"], "rows", "mi-probes").where(F.col("sign") != 0)
    found = probes.groupBy("feature", "cls", "pos").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"), F.first("k").alias("k"),
                                                        F.first("n_cls").alias("n_cls"), F.first("w").alias("w"))

    def mean(c):
        return F.sum(F.col("w") * digamma(F.col(c))) / F.sum("w")
    per = found.groupBy("feature").agg(F.sum("w").alias("n"), mean("k").alias("psi_k"), mean("n_cls").alias("psi_c"), mean("m").alias("psi_m"))
    mi = digamma(F.col("n")) + F.col("psi_k") - F.col("psi_c") - F.col("psi_m")
    if clip:
        mi = F.greatest(mi, F.lit(0.0))
    return (per.select("feature", F.round(mi, digits).alias("mi"))
               .orderBy(F.col("mi").desc(), "feature"))
