"""Stand-in inputs derived from the driver tables (fixtures F1-F7).

Each builder reads whole driver tables and assigns roles to all of their rows
(a parity split decides whether an event acts as a flow or as a label); no rows
are dropped to make checks cheaper.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import epoch_ms
from ..sources.catalog import SCENARIOS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def f1_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets: one conversation per user, direction alternating by event parity."""
    ev = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    host = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    server = F.lit("192.168.0.1")
    client_port = F.lit(1024) + F.col("user_id")
    return ev.select(
        F.col("event_id").alias("packet_id"), epoch_ms(ev, "ts").alias("ts_ms"),
        F.when(even, host).otherwise(server).alias("src_ip"),
        F.when(even, server).otherwise(host).alias("dst_ip"),
        F.when(even, client_port).otherwise(F.lit(80)).alias("src_port"),
        F.when(even, F.lit(80)).otherwise(client_port).alias("dst_port"),
        F.lit(6).alias("protocol"),
        (F.lit(40) + F.col("event_id") % 1460).cast("bigint").alias("bytes"))


def _f2_base(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", epoch_ms(ev, "ts").alias("ts_ms"), "event_type",
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("a"),
        F.concat(F.lit("192.168.0."), (F.col("event_id") % 16).cast("string")).alias("b"),
        (F.lit(1024) + F.col("user_id")).alias("pa"), F.lit(80).alias("pb"))


def _k(*cols):
    out = []
    for i, c in enumerate(cols):
        if i:
            out.append(F.lit("|"))
        out.append(F.col(c).cast("string") if isinstance(c, str) else c)
    return F.concat(*out)


def f2_all_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a flow."""
    return _f2_base(spark, sf_dir).select(
        F.col("event_id").alias("flow_id"), F.col("a").alias("src_ip"), F.col("b").alias("dst_ip"),
        F.col("pa").alias("src_port"), F.col("pb").alias("dst_port"), F.lit(6).alias("protocol"),
        F.col("ts_ms").alias("bidirectional_first_seen_ms"),
        _k("a", "b", "pa", "pb", F.lit("6")).alias("flow_key"),
        _k("b", "a", "pb", "pa", F.lit("6")).alias("flow_key_rev"))


def f2_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half of the events that acts as flows when two inputs are matched."""
    return f2_all_flows(spark, sf_dir).where(F.floor(F.col("flow_id") / 16) % 2 == 0)


def f2_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a label."""
    return _f2_base(spark, sf_dir).select(
        F.col("event_id").alias("label_id"), "ts_ms", F.col("event_type").alias("label"),
        F.when(F.col("event_id") % 3 == 0, _k("b", "a", "pb", "pa", F.lit("6")))
         .otherwise(_k("a", "b", "pa", "pb", F.lit("6"))).alias("flow_key"))


def f2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of the events, acting as labels."""
    return f2_all_labels(spark, sf_dir).where(F.floor(F.col("label_id") / 16) % 2 == 1)


F2_TOLERANCE_MS = 86_400_000
F3_TOLERANCE_MS = 15_552_000_000
F1_IDLE_MS = 21_600_000
F1_ACTIVE_MS = 86_400_000


def f3_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.where(F.col("l_linenumber") % 2 == 1)
              .withColumns({"flow_key": _k("l_orderkey", F.col("l_suppkey") % 2),
                            "ts_ms": epoch_ms(li, "l_shipdate")}))


def f3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where(F.col("l_linenumber") % 2 == 0).select(
        _k("l_orderkey", F.col("l_suppkey") % 2).alias("flow_key"),
        epoch_ms(li, "l_shipdate").alias("ts_ms"), F.col("l_returnflag").alias("label"))


def business_hours(ts):
    """Hours in which the label text has a 12-hour clock and can be repaired."""
    return F.hour(ts).between(8, 17)


def clock_text(ts):
    """Day-first text to the minute: 12-hour clock without AM/PM in business hours, else 24-hour clock."""
    return (F.when(business_hours(ts), F.date_format(ts, "d/M/yyyy h:mm"))
             .otherwise(F.date_format(ts, "d/M/yyyy H:mm")))


def f4_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label text of every event."""
    ev = table(spark, sf_dir, "events")
    minute = F.date_trunc("minute", F.col("ts"))
    return ev.select(
        "event_id", F.col("event_type").alias("label"),
        minute.cast("timestamp_ntz").alias("true_minute"),
        clock_text(minute).alias("raw_ts"))


def f5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("d_null"),
        F.lit(1.0).cast("double").alias("const"), F.col("l_returnflag").alias("label"))


def f5_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as flow rates give them: infinities, NaN, and a feature that decides its class."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 50
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("label"),
        F.when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, float("nan")).otherwise(F.col("l_extendedprice")).alias("rate"),
        F.when(k == 4, float("inf")).otherwise(F.ascii("l_returnflag") * 1000 + F.col("l_quantity")).alias("decides"))


def f6_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit(-1).cast("bigint"))
                     .otherwise((F.col("event_id") % 13) * F.pow(F.lit(10), F.col("event_id") % 9).cast("bigint"))
                     .alias("flow_duration_us"))


def scenario_of(id_col: str):
    """Scenario (capture day) by id modulo 5."""
    names = F.array(*[F.lit(s) for s in SCENARIOS])
    return F.element_at(names, (F.col(id_col) % 5).cast("int") + 1)


def f7_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 flows with a scenario column (event id modulo 5)."""
    return f2_flows(spark, sf_dir).withColumn("scenario", scenario_of("flow_id"))


def f7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f2_labels(spark, sf_dir).withColumn("scenario", scenario_of("label_id"))


def f1_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 packets split over three captures (packet id modulo 3), metered apart."""
    return f1_packets(spark, sf_dir).withColumn("capture", (F.col("packet_id") % 3).cast("int"))


def f1_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 packets, every fifth without ports (protocol 1), every fiftieth without a time."""
    ported, timed = F.col("packet_id") % 5 != 0, F.col("packet_id") % 50 != 7
    return f1_packets(spark, sf_dir).withColumns({
        "src_port": F.when(ported, F.col("src_port")), "dst_port": F.when(ported, F.col("dst_port")),
        "protocol": F.when(ported, F.col("protocol")).otherwise(1), "ts_ms": F.when(timed, F.col("ts_ms"))})


def f1_stream_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 packets with nulls, of which every seventh also has no size."""
    return f1_nulls(spark, sf_dir).withColumn("bytes", F.when(F.col("packet_id") % 7 != 3, F.col("bytes")))


def f8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as labelled flows: a class by price and quantity with every eleventh part mislabelled, keys in both directions."""
    li = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rule = F.when(net > 40000, "high").when(F.col("l_quantity") < 12, "low").otherwise("mid")
    a, b = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    odd = F.col("l_linenumber") % 2 == 1
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.when(F.col("l_partkey") % 11 == 0, "low").otherwise(rule).alias("label"),
        F.when(odd, F.concat_ws("|", a, b)).otherwise(F.concat_ws("|", b, a)).alias("flow_key"),
        F.when(odd, F.concat_ws("|", b, a)).otherwise(F.concat_ws("|", a, b)).alias("flow_key_rev"))


def f8_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 with a prediction: 'high' never comes, 'top' is no class, the seventh lines have none."""
    return f8_classes(spark, sf_dir).withColumn("prediction", F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
                                                .when(F.col("q") < 12, "low").when(F.col("p") > 60000, "top").otherwise("mid"))


def f9_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 flows under coarse keys (user and server group), so that keys repeat."""
    return f2_flows(spark, sf_dir).withColumn("flow_key", F.concat_ws("|", "src_ip", (F.col("flow_id") % 2).cast("string"))).drop("flow_key_rev")


def f9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 labels under the keys of F9: two of three rows are 'view', every twelfth has no label."""
    key = F.concat_ws("|", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), (F.col("event_id") % 2).cast("string"))
    ev = table(spark, sf_dir, "events")
    label = F.when(F.col("event_id") % 12 == 5, F.lit(None).cast("string")).when(F.col("event_id") % 3 != 0, "view").otherwise(F.col("event_type"))
    return ev.where(F.floor(F.col("event_id") / 16) % 2 == 1).select(
        F.col("event_id").alias("label_id"), epoch_ms(ev, "ts").alias("ts_ms"), label.alias("label"), key.alias("flow_key"))
