"""Column cleaning and time repair for label tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .timecols import epoch_ms

# Label-file column names and their standard names.
LABEL_COLUMN_MAPPING = {
    "Source IP": "src_ip",
    "Destination IP": "dst_ip",
    "Source Port": "src_port",
    "Destination Port": "dst_port",
    "Protocol": "protocol",
    "Label": "label",
}

# Day-first timestamp layouts accepted by default (with and without seconds).
DAYFIRST_FORMATS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names (C1). Duplicates may result; see C3."""
    return df.toDF(*[c.strip() for c in df.columns])


def replace_infinities(df: DataFrame) -> DataFrame:
    """+-inf and NaN in floating columns become null."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            out[f.name] = F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)
    return df.withColumns(out) if out else df


def remove_duplicated_cols(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    names = df.columns
    tmp = df.toDF(*[f"__c{i}" for i in range(len(names))])
    seen, keep = set(), []
    for i, n in enumerate(names):
        if n not in seen:
            seen.add(n)
            keep.append(F.col(f"__c{i}").alias(n))
    return tmp.select(*keep)


def remove_duplicated_rows(df: DataFrame) -> DataFrame:
    """Drop fully repeated rows, nulls comparing equal (C4)."""
    return df.dropDuplicates()


def dataset_cleanup(df: DataFrame) -> DataFrame:
    """C1 -> C2 -> C3 -> C4."""
    return (df.transform(clean_column_names).transform(replace_infinities)
              .transform(remove_duplicated_cols).transform(remove_duplicated_rows))


def rename_columns(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Rename by mapping; names that are absent are ignored."""
    mapping = LABEL_COLUMN_MAPPING if mapping is None else mapping
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def parse_dayfirst(col: str | Column, formats=DAYFIRST_FORMATS) -> Column:
    """Day-first text to a wall-clock timestamp; text that fits no format -> null."""
    c = F.col(col) if isinstance(col, str) else col
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    parsed = tries[0] if len(tries) == 1 else F.coalesce(*tries)
    return parsed.cast("timestamp_ntz")


def convert_to_datetime(df: DataFrame, col: str = "Timestamp", formats=DAYFIRST_FORMATS) -> DataFrame:
    return df.withColumn(col, parse_dayfirst(col, formats))


def with_epoch_ms(df: DataFrame, col: str = "Timestamp", out: str = "ts_ms") -> DataFrame:
    """Epoch milliseconds column."""
    return df.withColumn(out, epoch_ms(df, col))


def repair_12h_clock(col: str | Column, first_hour: int = 1, last_hour: int = 5) -> Column:
    """Hours 1..5 of a 12-hour clock without AM/PM are afternoon: add 12 h.

    Business-hours captures (9:00-17:00) make the reading unambiguous.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.hour(c).between(first_hour, last_hour),
                  c + F.make_dt_interval(F.lit(0), F.lit(12))).otherwise(c)


def adjust_12h_clock(df: DataFrame, col: str = "Timestamp") -> DataFrame:
    return df.withColumn(col, repair_12h_clock(col))


def shift_hours(df: DataFrame, col: str, hours: int) -> DataFrame:
    """Constant hour offset."""
    return df.withColumn(col, F.col(col) + F.make_dt_interval(F.lit(0), F.lit(int(hours))))


def tag_dataset(df: DataFrame, name: str) -> DataFrame:
    """Literal provenance column (C11)."""
    return df.withColumn("dataset_name", F.lit(name))


def to_numeric(col: str | Column, kind: str = "double") -> Column:
    """Text to number; invalid text -> null (C14)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast(kind)


def drop_null_rows(df: DataFrame, subset) -> DataFrame:
    """Drop rows with a null in any of the given columns."""
    return df.na.drop(subset=list(subset))


def log1p(col: str | Column) -> Column:
    """ln(1 + x)."""
    return F.log1p(F.col(col) if isinstance(col, str) else col)
