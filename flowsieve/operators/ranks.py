"""Running sums and ranks over a whole table, without a task that sees all of it."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sums(df: DataFrame, keys: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``upto``: the sum of ``weight`` over the rows of its ``keys`` up to and with it in
    ``order``, and ``total``: the sum over all of them.

    ``order`` ends in a unique column, so rows of one value may lie in several ranges. The
    ranges are written with their number; the table of range totals has one row per range and key in it.
    """
    cut = materialize(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), name)
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_range = cut.groupBy("__range", *keys).agg(F.sum(weight).alias("__sum"))
    by_key = Window.partitionBy(*keys)
    totals = per_range.select("__range", *keys, F.sum("__sum").over(by_key).alias("total"), F.coalesce(
        F.sum("__sum").over(by_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__before"))
    return (cut.withColumn("__upto", F.sum(weight).over(inside)).join(totals, ["__range", *keys])
               .withColumn("upto", F.col("__upto") + F.col("__before")).drop("__range", "__upto", "__before"))
