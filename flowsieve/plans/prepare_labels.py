"""Label preparation (P1): files -> clean -> standard names -> repaired time -> ts_ms."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import clean as C
from ..sources.files import read_label_csvs


def prepare_label_frame(df: DataFrame, *, hour_offset: int = 3, ts_col: str = "Timestamp",
                        mapping: dict | None = None, formats=C.DAYFIRST_FORMATS) -> DataFrame:
    """One lazy chain: C1-C4 -> C8 -> C6 -> C9 -> C10 -> C7 (order kept: +12 h before +3 h)."""
    return (df.transform(C.dataset_cleanup)
              .transform(lambda d: C.rename_columns(d, mapping))
              .transform(lambda d: C.convert_to_datetime(d, ts_col, formats))
              .transform(lambda d: C.adjust_12h_clock(d, ts_col))
              .transform(lambda d: C.shift_hours(d, ts_col, hour_offset))
              .transform(lambda d: C.with_epoch_ms(d, ts_col, "ts_ms")))


def prepare_labels(spark: SparkSession, paths, **kw) -> DataFrame:
    """Read a scenario's label files (S2) and prepare them."""
    return prepare_label_frame(read_label_csvs(spark, paths), **kw)
