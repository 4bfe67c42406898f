"""Run a registered query in Spark and its SQL in DuckDB; compare like the driver.

Comparison: same column names (sorted), same row count, same multiset of rows
after normalising values (floats rounded, timestamps as text).
"""
from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, digits)
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def rows_of(cols, tuples, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i], digits) for i in order) for r in tuples)


# Spark type name -> DuckDB type name, for the schema part of the comparison.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
              "smallint": "SMALLINT", "date": "DATE"}


def compare(spark_df, con, sql, digits=6):
    got_cols = spark_df.columns
    got_types = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
                 for f in spark_df.schema.fields}
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    exp_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    res = con.execute(sql)
    exp_cols = [d[0] for d in res.description]
    exp = res.fetchall()
    out = {"spark_rows": len(got), "oracle_rows": len(exp),
           "cols_match": sorted(got_cols) == sorted(exp_cols),
           "types_match": got_types == exp_types}
    if not out["types_match"]:
        out["type_diff"] = {n: (got_types.get(n), exp_types.get(n))
                            for n in set(got_types) | set(exp_types) if got_types.get(n) != exp_types.get(n)}
    if not out["cols_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(got_cols), sorted(exp_cols)
        out["values_match"] = False
        return out
    a, b = rows_of(got_cols, got, digits), rows_of(exp_cols, exp, digits)
    out["values_match"] = a == b
    if a != b:
        out["only_spark"] = list((a - b).items())[:5]
        out["only_oracle"] = list((b - a).items())[:5]
    return out
