"""Capture files: packet tables in Parquet, of which some may be unreadable."""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: A Parquet file without rows is its footer; no footer of a packet table is as long as this.
LONGEST_EMPTY = 64 << 20


def read_captures(spark: SparkSession, paths, schema) -> DataFrame:
    """Packets of all captures in one scan; a file that can't be read is skipped, one that breaks gives what is before the break.

    The schema is given, so no file has to be opened while the plan is made. ``capture_states`` tells which files those are.
    """
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*paths)


def _footers(batches):
    """Files (path, content) whose bytes are a whole Parquet file of no rows."""
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    for b in batches:
        keep = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                if pq.read_metadata(io.BytesIO(content.as_py())).num_rows == 0:
                    keep.append(path)
            except (pa.ArrowException, OSError):
                pass
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], names=["file"])


def capture_states(spark: SparkSession, paths, schema) -> DataFrame:
    """(file, state, packets_listed, packets_read) of every capture file.

    The footers tell how many packets a file lists (a scan of no column reads nothing else); a second scan decodes
    every column. ``ok``: all were read; ``empty``: a whole file that lists none; ``broken``: some listed packets
    can't be decoded; ``unreadable``: no footer. Only files that gave no packet are opened to tell an empty one
    from an unreadable one, and of those only short ones: an empty file is a footer.
    """
    ship_package(spark)
    name = F.col("_metadata.file_path").alias("file")
    files = materialize(spark.read.format("binaryFile").load(list(paths)).select(name, "length"), "capture-files")
    listed = read_captures(spark, paths, schema).select(name).groupBy("file").agg(F.count(F.lit(1)).alias("listed"))
    columns = [F.col(f"`{f.name}`") for f in spark.createDataFrame([], schema).schema.fields]
    # a checksum of all rows, written with the counts, makes the scan decode every column
    read = read_captures(spark, paths, schema).select(name, F.xxhash64(*columns).alias("h")).groupBy("file").agg(
        F.count(F.lit(1)).alias("read"), F.bit_xor("h").alias("checksum"))
    counts = materialize(files.join(listed, "file", "left").join(read, "file", "left").select(
        "file", "length", "checksum", F.coalesce("listed", F.lit(0)).alias("packets_listed"), F.coalesce("read", F.lit(0)).alias("packets_read")),
        "capture-counts")
    silent = counts.where((F.col("packets_listed") == 0) & (F.col("length") < LONGEST_EMPTY)).select("file")
    some = [unquote(r["file"]) for r in silent.collect()]  # names only, and the driver was given the names
    empty = spark.createDataFrame([], "file string")
    if some:
        empty = spark.read.format("binaryFile").load(some).select(name, "content").mapInArrow(_footers, "file string")
    state = (F.when(F.col("packets_listed") > F.col("packets_read"), "broken").when(F.col("packets_listed") > 0, "ok")
              .when(F.col("e").isNotNull(), "empty").otherwise("unreadable"))
    return counts.join(empty.select("file", F.lit(1).alias("e")), "file", "left").select("file", state.alias("state"), "packets_listed", "packets_read")


def capture_report(spark: SparkSession, paths, schema) -> DataFrame:
    """One row: capture files listed, packets read, files of which no packet was read; and of these and the others
    how many are empty, unreadable, or broken, with the packets lost in broken ones."""
    def files(state):
        return F.count_if(F.col("state") == state).alias(f"files_{state}")
    return capture_states(spark, paths, schema).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("packets_read"), F.lit(0)).cast("bigint").alias("packets"),
        F.count_if(F.col("packets_read") == 0).alias("files_without_packets"), files("empty"), files("unreadable"), files("broken"),
        F.coalesce(F.sum(F.col("packets_listed") - F.col("packets_read")), F.lit(0)).cast("bigint").alias("packets_lost"))
