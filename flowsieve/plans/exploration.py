"""The exploration run (P3): all reports on the final table from one scan of it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import split_features
from ..operators import profile as P
from ..operators import quality as Q
from ..session import materialize


def explore(df: DataFrame, label: str = "label", features=None, bins: int = 25, threshold: float = 0.9,
            top: int = 15) -> DataFrame:
    """Rows (report, item, other, stat, value): every report of the exploration in one long table.

    The source is scanned once, to write its feature and label columns in the shared folder; all reports read
    that narrow table. ``item`` is the feature or class, ``other`` a second feature, class or bin. Reports: rows, nulls, classes, describe,
    dispersion, histogram, box plot, correlated pairs, mutual information, top features.
    """
    feats = list(features) if features else [c for c in split_features(df)[0] if c != label]
    table = materialize(df.select(*[F.col(f"`{c}`") for c in [*feats, label]]), "exploration")

    def long(report, frame, item, other, stats):
        no = F.lit(None).cast("string")
        cells = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats])).alias("c")
        return frame.select(F.lit(report).alias("report"), F.col(item).cast("string").alias("item") if item else no.alias("item"),
                            F.col(other).cast("string").alias("other") if other else no.alias("other"), cells).select(
                                "report", "item", "other", "c.stat", "c.value")
    # each of these is one row a feature and used twice: written, so it is computed once
    information = materialize(P.mutual_information_binned(table, feats, label, bins), "exploration-mi")
    best = information.orderBy(F.col("mi").desc(), "feature").limit(top)
    return reduce(DataFrame.union, [
        long("rows", table.agg(F.count(F.lit(1)).alias("n")), None, None, ["n"]),
        long("nulls", Q.null_percentage(table), "column_name", None, ["null_pct"]),
        long("classes", Q.value_counts(table, label), label, None, ["n"]),
        long("describe", P.describe(table, feats), "feature", None, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
        long("dispersion", P.dispersion(table, feats), "feature", None, ["cv"]),
        long("histogram", P.histogram(table, feats, bins), "feature", "bin", ["n"]),
        long("boxplot", P.boxplot_stats(table, feats), "feature", None, ["whisker_low", "whisker_high", "n_outliers"]),
        long("correlation", P.high_correlation_pairs(table, feats, threshold), "feature_a", "feature_b", ["r"]),
        long("information", information, "feature", None, ["mi"]),
        long("top", best, "feature", None, ["mi"])])
