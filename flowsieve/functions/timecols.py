"""Time conversions that do not depend on the session time zone."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_ms(df: DataFrame, col: str) -> Column:
    """Epoch milliseconds of a timestamp column.

    A wall-clock (``TIMESTAMP_NTZ``) column is measured from the wall-clock epoch,
    so the result is the same under any session time zone; an instant
    (``TIMESTAMP``) column uses ``unix_millis``.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MILLISECOND, {_EPOCH_NTZ}, `{col}`)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(F.col(col))
    if isinstance(dtype, T.DateType):
        return F.unix_millis(F.col(col).cast("timestamp_ntz").cast("timestamp"))
    raise TypeError(f"column {col!r} is {dtype.simpleString()}, not a timestamp")


def from_epoch_ms(col: str | Column) -> Column:
    """Epoch milliseconds to a wall-clock timestamp (C20), zone independent."""
    c = F.col(col) if isinstance(col, str) else col
    return F.expr(f"{_EPOCH_NTZ}") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(38,3)") / F.lit(1000))
