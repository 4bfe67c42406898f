"""File sources and sinks."""
from __future__ import annotations

import csv
import io
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text read as missing in label CSV files (the common default NA tokens).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")


def _header_names(raw_header: str) -> list[str]:
    """Parse a header line; repeated names get ``.1``, ``.2`` ... suffixes in order."""
    names = next(csv.reader(io.StringIO(raw_header)))
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            cand = f"{n}.{seen[n]}"
            while cand in seen:
                seen[n] += 1
                cand = f"{n}.{seen[n]}"
            seen[cand] = 0
            out.append(cand)
        else:
            seen[n] = 0
            out.append(n)
    return out


def _file_groups(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], str, str]]:
    """Files by encoding and header line: ``(files, encoding, header)``, from one scan of all paths.

    A file is UTF-8 when all its lines are valid UTF-8 (whatever characters they hold), else
    ISO-8859-1. One row per file comes back.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.when((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""),
               F.monotonically_increasing_id()).alias("at"))
    heads = (lines.groupBy("file").agg(F.min_by(F.col("value").cast("binary"), "at").alias("header"),
                                       F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
                  .where(F.col("header").isNotNull()).orderBy("file").collect())
    groups: dict = {}
    for h in heads:
        encoding = "UTF-8" if h["utf8"] else "ISO-8859-1"
        header = bytes(h["header"]).decode("utf-8-sig" if h["utf8"] else "latin-1").rstrip("\r")
        groups.setdefault((encoding, header), []).append(unquote(h["file"]))
    return [(files, encoding, header) for (encoding, header), files in groups.items()]


def _read_group(spark: SparkSession, files: list[str], encoding: str, header: str) -> DataFrame:
    names = _header_names(header)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    df = (spark.read.schema(schema)
          .option("header", True).option("enforceSchema", True)
          .option("encoding", encoding).option("mode", "PERMISSIVE")
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(files))
    na = list(NA_TOKENS)
    return df.select(*[F.when(F.col(f"_c{i}").isin(na), None).otherwise(F.col(f"_c{i}")).alias(n)
                       for i, n in enumerate(names)])


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan one label CSV (file or directory of part files) as all-string columns.

    The header row is parsed by us so repeated names stay distinguishable; part files
    with other headers line up by name. Files that aren't valid UTF-8 are read as ISO-8859-1.
    """
    return read_label_csvs(spark, [path], strip_names=False)


def read_label_csvs(spark: SparkSession, paths, strip_names: bool = True) -> DataFrame:
    """Read several label files and union them by name, missing columns null.

    One job finds encoding and header of all files, then files that share both are one scan.
    Names are stripped per scan (first of equal names kept) before the union, so
    files that spell a column with or without blanks still line up.
    """
    from ..functions.clean import clean_column_names, remove_duplicated_cols

    frames = [_read_group(spark, *g) for g in _file_groups(spark, list(paths))]
    if not frames:
        raise ValueError(f"no header line in {list(paths)}")
    if strip_names:
        frames = [d.transform(clean_column_names).transform(remove_duplicated_cols) for d in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Parquet scan; the column list is pruned at the scan (S3)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def save_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink; parent folders are created by the writer."""
    w = df.write.mode(mode)
    if partition_by:
        # only the partitions that are written are replaced: another scenario's stay
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def merge_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """Union all scenario tables under one folder, schemas merged by name.

    Raises when the folder holds no parquet data.
    """
    try:
        return spark.read.option("mergeSchema", True).parquet(root)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise ValueError(f"no parquet data under {root}") from e
        raise


def merge_datasets(frames: dict[str, DataFrame]) -> DataFrame:
    """Union several datasets into one, tagging each with ``dataset_name``."""
    tagged = [df.withColumn("dataset_name", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def rows_per_file(df: DataFrame) -> DataFrame:
    """Row count per input file name."""
    return (df.select(F.col("_metadata.file_name").alias("file_name"))
              .groupBy("file_name").agg(F.count(F.lit(1)).alias("rows")))
