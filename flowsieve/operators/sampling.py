"""Ordering, top-k and sampling (O4-O7). Limits here are the feature itself."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview_rows(df: DataFrame, n: int = 10, order_by=("id",)) -> DataFrame:
    """First n rows in a deterministic order (O4): top-k, no full sort."""
    return df.orderBy(*order_by).limit(n)


def top_features(scores: DataFrame, k: int = 15, score: str = "mi", threshold: float | None = None) -> DataFrame:
    """Best k features by score, optionally above a threshold."""
    if threshold is not None:
        scores = scores.where(F.col(score) > threshold)
    return scores.orderBy(F.col(score).desc_nulls_last(), "feature").limit(k)


def _part(c: str):
    """A column's share of the hashed row key: length-prefixed text, or a mark for null."""
    text = F.col(f"`{c}`").cast("string")
    return F.when(text.isNull(), F.lit("n|")).otherwise(
        F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit("|")))


def sample_fixed_n(df: DataFrame, n: int, seed: int, id_cols=None) -> DataFrame:
    """Exactly n rows (or all, if fewer) without replacement, reproducible.

    Null ids are hashed like any other value, so no row is lost to them.

    The sample is the n rows with the smallest ``md5(id | seed)``. Rather than
    sorting everything (a top-n merge that would receive n rows from every
    partition), rows are first filtered by a threshold on a 60-bit prefix of the
    hash, chosen from the row count so that at least n rows pass (raised and
    re-counted if not). Every row that fails the filter has a larger hash than
    every row that passes, so the top-n of the survivors - about n rows in
    total - is exactly the top-n of the table.
    """
    cols = list(id_cols) if id_cols else df.columns
    h = F.md5(F.concat(*[_part(c) for c in cols], F.lit(str(seed))))
    hashed = df.withColumn("__h", h).withColumn(
        "__k", F.conv(F.substring("__h", 1, 15), 16, 10).cast("decimal(20,0)"))
    total = df.count()
    if total <= n:
        return df
    space = 16 ** 15
    frac = min(1.0, n / total * 1.05 + 64 / total)
    while True:
        cut = min(space, int(space * frac) + 1)
        kept = hashed.where(F.col("__k") < F.lit(cut))
        if cut >= space or kept.count() >= n:
            break
        frac = min(1.0, frac * 1.5)
    return kept.orderBy("__h").limit(n).drop("__h", "__k")
