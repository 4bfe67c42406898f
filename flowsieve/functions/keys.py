"""Five-tuple flow keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The five-tuple column order of a key and its separator.
KEY_PARTS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
KEY_SEP = "|"


def _key(parts) -> Column:
    # concat (not concat_ws): one null part makes the whole key null.
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(KEY_SEP))
        cols.append(F.col(p).cast("string"))
    return F.concat(*cols)


def flow_key() -> Column:
    """``src_ip|dst_ip|src_port|dst_port|protocol`` compared as text."""
    return _key(KEY_PARTS)


def flow_key_rev() -> Column:
    """The same conversation seen from the other end (endpoints swapped)."""
    s_ip, d_ip, s_port, d_port, proto = KEY_PARTS
    return _key((d_ip, s_ip, d_port, s_port, proto))


def with_flow_keys(df: DataFrame) -> DataFrame:
    """Add ``flow_key`` and ``flow_key_rev``."""
    return df.withColumns({"flow_key": flow_key(), "flow_key_rev": flow_key_rev()})
