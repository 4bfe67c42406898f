"""Raw label CSV files derived from the ``events`` table (fixture F4 as files).

Two folders are written under a fresh directory in the shared checkpoint folder:

* ``utf8``  - even ``event_id`` rows (all with ``split=False``), UTF-8;
* ``latin1`` - odd ``event_id`` rows (all with ``split=False``), ISO-8859-1, a byte 0x96 inside each label
  and one extra column ``Label`` (no blank) that repeats ``" Label"`` after names
  are stripped.

Rows with ``event_id % 10`` in (0, 1) are written twice, and each file gets one
line of commas only. Column names keep the blank after each comma.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.catalog import SCENARIOS
from .standins import clock_text, f1_packets, scenario_of, table

DASH = chr(0x96)
HEADER = ("Flow ID", " Source IP", " Source Port", " Destination IP", " Destination Port",
          " Protocol", " Timestamp", " Label")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    minute = F.date_trunc("minute", F.col("ts"))
    base = ev.select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias(HEADER[0]),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias(HEADER[1]),
        (F.lit(1024) + F.col("user_id")).cast("string").alias(HEADER[2]),
        F.concat(F.lit("192.168.0."), (F.col("event_id") % 16).cast("string")).alias(HEADER[3]),
        F.lit("80").alias(HEADER[4]), F.lit("6").alias(HEADER[5]),
        clock_text(minute).alias(HEADER[6]),
        F.col("event_type").alias(HEADER[7]))
    twice = base.where((F.col("event_id") % 10).isin(0, 1))
    return base.unionByName(twice)


def _null_row(spark: SparkSession, cols) -> DataFrame:
    return spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in cols])


def write_label_files(spark: SparkSession, sf_dir: str, split: bool = True) -> dict[str, str]:
    root = f"{shared_dir(spark)}/label-csv-{uuid.uuid4().hex}"
    rows = label_rows(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    utf8 = (rows.where(even) if split else rows).drop("event_id")
    utf8 = utf8.unionByName(_null_row(spark, utf8.columns))
    latin = ((rows.where(~even) if split else rows).drop("event_id")
             .withColumn(HEADER[7], F.concat(F.lit(f"Web Attack {DASH} "), F.col(HEADER[7])))
             .withColumn("Label", F.lit("dup")))
    latin = latin.unionByName(_null_row(spark, latin.columns))
    out = {}
    for name, df, enc in (("utf8", utf8, "UTF-8"), ("latin1", latin, "ISO-8859-1")):
        path = f"{root}/{name}"
        (df.write.mode("overwrite").option("header", True).option("encoding", enc)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .csv(path))
        out[name] = path
    return out


DATASET_CLOCK_MS = 3 * 3_600_000


def write_dataset(spark: SparkSession, sf_dir: str) -> dict:
    """Raw files of a whole dataset, and their catalog: label text and captures of every event.

    Events are dealt to scenarios by id. Labels name the packets' endpoints; the captures'
    clock is three hours ahead of the label text. One capture of monday is no Parquet file.
    """
    root = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    rows = label_rows(spark, sf_dir).withColumn(HEADER[3], F.lit("192.168.0.1"))
    (rows.withColumn("scenario", scenario_of("event_id")).drop("event_id")
         .write.partitionBy("scenario").option("header", True).csv(f"{root}/labels"))
    packets = f1_packets(spark, sf_dir).withColumn("ts_ms", F.col("ts_ms") + DATASET_CLOCK_MS)
    (packets.withColumn("scenario", scenario_of("packet_id"))
            .write.partitionBy("scenario").parquet(f"{root}/captures"))
    spark.range(1).select(F.lit("not a capture").alias("value")).write.text(f"{root}/broken")
    out = {sc: {"labels": [f"{root}/labels/scenario={sc}"], "captures": [f"{root}/captures/scenario={sc}"]}
           for sc in SCENARIOS}
    out["monday"]["captures"].append(f"{root}/broken")
    return {"events_dataset": out}


def write_odd_captures(spark: SparkSession, sf_dir: str) -> dict:
    """The dataset's captures with two more on tuesday: one without packets, one whose times are no numbers."""
    catalog = write_dataset(spark, sf_dir)
    root = f"{shared_dir(spark)}/odd-captures-{uuid.uuid4().hex}"
    packets = f1_packets(spark, sf_dir)
    packets.limit(0).write.parquet(f"{root}/empty")
    packets.withColumn("ts_ms", F.concat(F.lit("at "), F.col("ts_ms").cast("string"))).coalesce(1).write.parquet(f"{root}/text")
    catalog["events_dataset"]["tuesday"]["captures"] += [f"{root}/empty", f"{root}/text"]
    return catalog


REPEATED_HEADER = "Flow ID,Port,Port,Label"


def write_repeated_header(spark: SparkSession, sf_dir: str) -> str:
    """Label files whose header has ``Port`` twice; every ninth row lacks the second."""
    path = f"{shared_dir(spark)}/repeated-header-{uuid.uuid4().hex}"
    ev = table(spark, sf_dir, "events")
    row = F.concat_ws(",", F.col("event_id").cast("string"), (F.col("user_id") % 1000).cast("string"),
                      F.when(F.col("event_id") % 9 != 4, (F.col("event_id") % 97).cast("string")).otherwise(""), "event_type")
    lines = ev.select(row.alias("value"), (F.col("event_id") % 3).cast("int").alias("part")).union(
        spark.range(3).select(F.lit(REPEATED_HEADER), F.col("id").cast("int")))
    # each file begins with the header line
    (lines.repartition(3, "part").sortWithinPartitions("part", F.col("value") != REPEATED_HEADER)
          .write.partitionBy("part").text(path))
    return path
