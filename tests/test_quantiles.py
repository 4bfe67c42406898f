"""Distributed exact quantiles equal the single-pass exact percentile."""
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("max_exact,buckets", [(50, 8), (1000, 64), (100_000, 4096)])
def test_refinement_matches_percentile(spark, max_exact, buckets):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    long = (li.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("a"),
                      F.col("l_quantity").alias("b"), (-F.col("l_tax")).alias("c"),
                      F.lit(3.0).alias("k"))
              .unpivot(["g"], ["a", "b", "c", "k"], "feature", "value"))
    tiny = spark.createDataFrame([("x", "solo", 7.5)], "g string, feature string, value double")
    long = long.unionByName(tiny)
    got = {(r.g, r.feature, r.p): r.q for r in
           exact_quantiles(long, ["g", "feature"], PROBS, max_exact=max_exact, buckets=buckets).collect()}
    ref = long.groupBy("g", "feature").agg(F.percentile("value", F.array(*[F.lit(p) for p in PROBS])).alias("qs"))
    n = 0
    for r in ref.collect():
        for p, q in zip(PROBS, r.qs):
            assert got[(r.g, r.feature, p)] == pytest.approx(q, rel=1e-12, abs=1e-12), (r.g, r.feature, p)
            n += 1
    assert n == len(got)


def test_refinement_with_written_tables(spark):
    import flowsieve.operators.quantiles as QQ
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    long = li.select(F.lit("p").alias("feature"), F.col("l_extendedprice").alias("value"))
    got = {r.p: r.q for r in QQ.exact_quantiles(long, ["feature"], PROBS, max_exact=100, buckets=16).collect()}
    ref = long.agg(F.percentile("value", F.array(*[F.lit(p) for p in PROBS])).alias("qs")).first().qs
    for p, q in zip(PROBS, ref):
        assert got[p] == pytest.approx(q, rel=1e-12)


def test_unresolved_targets_raise(spark):
    import flowsieve.operators.quantiles as QQ
    long = spark.range(5000).select(F.lit("p").alias("feature"), F.col("id").cast("double").alias("value"))
    with pytest.raises(RuntimeError):
        QQ.exact_quantiles(long, ["feature"], PROBS, max_exact=2, buckets=2, max_rounds=2)
