"""Fixed-size sampling equals a full hash sort; column roles follow the fixed lists."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.roles import split_features
from flowsieve.operators.sampling import sample_fixed_n

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _full_sort(df, n, seed):
    parts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.lit("|"))
             for c in KEY]
    h = F.md5(F.concat(*parts, F.lit(str(seed))))
    return df.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")


def test_threshold_sample_equals_full_sort(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(*KEY, "l_quantity")
    for n, seed in ((1, 1), (1000, 42), (59_999, 5)):
        got = sorted(tuple(r) for r in sample_fixed_n(li, n, seed, KEY).collect())
        exp = sorted(tuple(r) for r in _full_sort(li, n, seed).collect())
        assert got == exp and len(got) == n


def test_sample_larger_than_table_returns_all(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(*KEY)
    assert sample_fixed_n(li, 10**9, 42, KEY).count() == li.count()


def test_split_features_roles(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in [
        ("id", T.LongType()), ("src_ip", T.StringType()), ("src_port", T.IntegerType()),
        ("protocol", T.IntegerType()), ("bidirectional_packets", T.LongType()),
        ("bidirectional_first_seen_ms", T.LongType()), ("application_name", T.StringType()),
        ("mean_ps", T.DoubleType()), ("label", T.StringType()), ("ip_version", T.StringType()),
        ("dataset_name", T.StringType())]])
    df = spark.createDataFrame([], schema)
    numeric, categorical = split_features(df)
    assert numeric == ["bidirectional_packets", "mean_ps"]
    assert categorical == ["src_port", "protocol", "ip_version"]
