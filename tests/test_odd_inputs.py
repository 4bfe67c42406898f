"""Infinities, magnitudes, dotted names and null packets."""
import math

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from flowsieve.operators import profile as P
from flowsieve.operators import quality as QA
from flowsieve.operators.mutual_info import mutual_information_knn
from flowsieve.operators.quantiles import exact_quantiles, power
from flowsieve.streaming.metering import meter_flows_stream

INF = math.inf


@pytest.mark.parametrize("values", [
    [INF, -INF, *range(50)],
    [INF] * 30 + [-INF] * 3 + [0.5, -0.5],
    [1e308, -1e308, 1e300, 5e-324, -5e-324, 0.0, -0.0, *[x / 7 for x in range(40)]],
    [10.0 ** e for e in range(-300, 300, 7)],
    [1.0 + i * 2.0 ** -52 for i in range(60)],  # neighbours on the scale of doubles
    [-(10.0 ** e) for e in range(-20, 20)] + [1.0] * 25,
])
def test_quartiles_of_extreme_values_without_sorting_them(spark, values):
    df = spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, ["feature"], probs, max_exact=1, buckets=16, max_rounds=40).collect()}
    s = sorted(values)
    for p in probs:
        h = (len(s) - 1) * p
        lo, hi = s[math.floor(h)], s[math.ceil(h)]
        want = lo if lo == hi or h == math.floor(h) else lo + (h - math.floor(h)) * (hi - lo)
        assert got[p] == want or (math.isnan(got[p]) and math.isnan(want))


def test_power_never_decreases(spark):
    v = sorted({*(s * 10.0 ** e for s in (1, -1) for e in range(-323, 309, 3)), 0.0, INF, -INF,
                *np.nextafter(1024.0, [0, 2000]).tolist(), 1024.0})
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
           .orderBy("i").select(power(F.col("v"))).collect()]
    assert got == sorted(got) and got[0] == -2200 and got[-1] == 2200


def test_reports_on_dotted_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", 1), (2.0, None, "b", 2), (5.0, 4.0, "a", 3)], "`x.1` double, x double, `the.label` string, id int")
    both = ["x", "x.1"]
    assert {r[0] for r in P.unpivot_features(df, both, ids=["the.label"]).select("feature").distinct().collect()} == set(both)
    assert {r["feature"]: r["count"] for r in P.describe(df, both).collect()} == {"x": 2, "x.1": 3}
    assert {r["feature"] for r in P.dispersion(df, both).collect()} == set(both)
    assert P.histogram(df, both, bins=2).count() == 4
    assert P.boxplot_stats(df, both).count() == 2
    assert P.correlation_matrix(df, both).count() == 4
    assert {r["column_name"]: r["non_null"] for r in QA.table_profile(df).collect()} == {"x.1": 3, "x": 2, "the.label": 3, "id": 3}
    assert QA.null_percentage(df).where("null_pct > 0").count() == 1
    assert QA.duplicate_row_count(df).first()["n_distinct"] == 3


def test_knn_information_survives_an_infinity(spark):
    rows = [(i, float(i % 2 * 100 + i / 1000), "ab"[i % 2]) for i in range(400)]
    clean = mutual_information_knn(spark.createDataFrame(rows, "id int, x double, label string"), ["x"], id_cols=["id"]).first()["mi"]
    rows += [(1000, INF, "a"), (1001, -INF, "b"), (1002, math.nan, "a")]
    odd = mutual_information_knn(spark.createDataFrame(rows, "id int, x double, label string"), ["x"], id_cols=["id"]).first()["mi"]
    assert clean > 0.6 and odd == clean


def test_knn_information_with_repeated_ids(spark):
    rows = [(i, float((i * 37) % 101) + (i % 3) * 40, "abc"[i % 3]) for i in range(300)]
    schema = "id int, x double, label string"
    one = mutual_information_knn(spark.createDataFrame(rows, schema), ["x"], id_cols=["id"], jitter=False).first()["mi"]
    same = mutual_information_knn(spark.createDataFrame([(7, *r[1:]) for r in rows], schema), ["x"], id_cols=["id"], jitter=False).first()["mi"]
    assert one == same > 0


def test_packets_without_a_time_are_counted_in_the_stream(spark, tmp_path):
    schema = "packet_id long, ts_ms long, src_ip string, dst_ip string, src_port long, dst_port long, protocol int, bytes long"
    rows = [(1, 1000, "a", "b", 1, 2, 6, 60), (2, None, "a", "b", 1, 2, 6, 5), (3, 1500, "b", "a", 2, 1, 6, None), (4, 1600, "a", "b", 1, 2, 6, 10),
            (5, 1000, "c", "d", 1, 2, 6, None), (6, 10 ** 9, "e", "f", 1, 2, 6, 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = (meter_flows_stream(stream, 5000, 60_000, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(p["observedMetrics"]["packets_without_time"]["n"] for p in q.recentProgress if p["numInputRows"]) == 1
    got = {(r["src_ip"], r["bidirectional_packets"]): r["bidirectional_bytes"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 3): 70, ("c", 1): None}


def test_broken_captures_are_told_apart(spark, tmp_path):
    from flowsieve.sources.captures import capture_report, capture_states
    schema = "packet_id long, src_ip string"
    rows = spark.range(20_000).select(F.col("id").alias("packet_id"), F.md5(F.col("id").cast("string")).alias("src_ip"))
    good = str(tmp_path / "a good=one")
    rows.coalesce(1).write.parquet(good)
    half = str(tmp_path / "half")
    rows.coalesce(1).write.option("parquet.block.size", 65536).option("compression", "gzip").parquet(half)
    spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"PAR1 nothing here")
    part = next((tmp_path / "half").glob("part-*.parquet"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2:len(data) // 2 + 4000] = b"\x00" * 4000
    part.write_bytes(data)
    next((tmp_path / "half").glob(".*.crc")).unlink()
    paths = [good, half, str(tmp_path / "none"), str(tmp_path / "bad")]
    got = {r["state"]: r for r in capture_states(spark, paths, schema).collect()}
    assert set(got) == {"ok", "broken", "empty", "unreadable"}
    assert got["ok"]["packets_read"] == got["broken"]["packets_listed"] == 20_000 > got["broken"]["packets_read"]
    report = capture_report(spark, paths, schema).first()
    assert (report["files"], report["files_empty"], report["files_unreadable"], report["files_broken"]) == (4, 1, 1, 1)
    assert report["packets"] + report["packets_lost"] == 40_000
