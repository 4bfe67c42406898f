"""Data-quality reports.

Every report is one or two aggregate jobs with map-side partial aggregation; no
report collects rows or groups to the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

# A window over the whole (tiny) result of an aggregate: used only on outputs whose
# size is bounded by a fixed number of groups, never on data rows.
def _all():
    return Window.partitionBy()

# Flow-duration ranges in microseconds (upper bounds, right-closed,
# the first range includes 0; the last range is open-ended) and their names.
DURATION_EDGES_US = (0, 1_000, 10_000, 100_000, 1_000_000, 10_000_000, 60_000_000,
                     120_000_000, 300_000_000)
DURATION_RANGE_NAMES = ("0-1ms", "1-10ms", "10-100ms", "100ms-1s", "1s-10s", "10s-1min",
                        "1-2min", "2-5min", "5min+")


def value_counts(df: DataFrame, col: str, dropna: bool = True, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first (A1); ``dropna=False`` keeps null (A2)."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias(name))
               .orderBy(F.col(name).desc(), F.col(col).asc_nulls_last()))


def distinct_count(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    """Distinct non-null values (A3); HyperLogLog++ when ``approximate``."""
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(fn(col).alias(f"n_distinct_{col}"))


def key_ambiguity(df: DataFrame, key: str = "flow_key", label: str = "label") -> DataFrame:
    """Key uniqueness and label conflicts in one row.

    Per key: occurrences and distinct labels (partial aggregation), then one
    global conditional aggregate. Percentages use ``try_divide`` (no repeated
    keys gives null, not an error).
    """
    per_key = (df.where(F.col(key).isNotNull()).groupBy(key)
                 .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("n_labels")))
    rep = F.col("n") > 1
    s = per_key.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count(F.when(F.col("n") == 1, 1)).alias("keys_once"),
        F.count(F.when(rep, 1)).alias("keys_repeated"),
        F.coalesce(F.sum(F.when(rep, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_of_repeated_keys"),
        F.count(F.when(rep & (F.col("n_labels") > 1), 1)).alias("conflicting_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"))

    def pct(a, b):
        return F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 6)

    return s.select("distinct_keys", "keys_once", "keys_repeated", "rows_of_repeated_keys",
                    "conflicting_keys",
                    pct("keys_once", "distinct_keys").alias("pct_keys_once"),
                    pct("keys_repeated", "distinct_keys").alias("pct_keys_repeated"),
                    pct("rows_of_repeated_keys", "rows").alias("pct_rows_of_repeated_keys"),
                    pct("conflicting_keys", "keys_repeated").alias("pct_conflicting_of_repeated"),
                    pct("conflicting_keys", "distinct_keys").alias("pct_conflicting_of_keys"))


def conflict_detail(df: DataFrame, key: str = "flow_key", label: str = "label") -> DataFrame:
    """Label counts for every repeated key with more than one label."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "conflict-counts")   # read twice below
    conflicting = (counts.groupBy(key)
                         .agg(F.sum("n").alias("rows"), F.count(F.col(label)).alias("n_labels"))
                         .where((F.col("rows") > 1) & (F.col("n_labels") > 1)).select(key))
    return counts.join(conflicting, key, "left_semi")


def flow_label_ratio(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Flow and label row counts and their ratio rounded to 3 digits (A5)."""
    both = (flows.select(F.lit(1).alias("f"), F.lit(0).alias("l"))
                 .unionByName(labels.select(F.lit(0).alias("f"), F.lit(1).alias("l"))))
    return (both.agg(F.coalesce(F.sum("f"), F.lit(0)).cast("bigint").alias("n_flows"),
                     F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("n_labels"))
             .select("n_flows", "n_labels",
                     F.round(F.try_divide(F.col("n_flows").cast("double"), F.col("n_labels")), 3)
                      .alias("flows_per_label")))


# Spellings under which the label column may come.
LABEL_NAMES = ("Label", " Label", "label")


def find_column(df: DataFrame, names=LABEL_NAMES) -> str:
    """The first of ``names`` that is a column of ``df`` (C27); an error names what was looked for and what is there."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of the columns {list(names)} found; columns: {df.columns}")


def flow_label_report(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (item, name, n): row counts, label distribution, and the columns of both tables by position (A5)."""
    spark = flows.sparkSession
    c = find_column(labels)
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("item"), F.lit(k).alias("name"), "n")
            for k, df in (("flows", flows), ("labels", labels))]
    dist = (labels.groupBy(F.col(f"`{c}`").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
                  .select(F.lit("label").alias("item"), "name", "n"))
    names = [(f"{k} column", x, i) for k, df in (("flows", flows), ("labels", labels))
             for i, x in enumerate(df.columns, 1)]
    return rows[0].union(rows[1]).union(dist).union(spark.createDataFrame(names, "item string, name string, n long"))


def label_counts_by_stage(stages: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Label counts of several stages in one table."""
    out = None
    for name, df in stages.items():
        c = (df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("stage", F.lit(name)))
        out = c if out is None else out.unionByName(c)
    return out


def duration_histogram(spark: SparkSession, df: DataFrame, col: str) -> DataFrame:
    """Nine fixed duration ranges with counts and percentages.

    Non-numeric text becomes null and is left out; out-of-range values (e.g.
    negative) are in the denominator but in no range. Empty ranges are shown:
    the counts are right-joined to the fixed nine-row range table.
    """
    if col not in df.columns:
        raise ValueError(f"column {col!r} not found")
    d = F.col(col).try_cast("double")
    e = DURATION_EDGES_US
    rid = F.when((d >= e[0]) & (d <= e[1]), 0)
    for i in range(1, len(e) - 1):
        rid = rid.when((d > e[i]) & (d <= e[i + 1]), i)
    rid = rid.when(d > e[-1], len(e) - 1)
    per = (df.select(d.alias("d"), rid.alias("range_id")).where(F.col("d").isNotNull())
             .groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("total", F.sum("n").over(_all())))          # <= 10 rows
    ranges = spark.createDataFrame(list(enumerate(DURATION_RANGE_NAMES)), "range_id int, range_label string")
    # full join keeps the out-of-range row (null range_id) until its total is read
    joined = (per.join(ranges, "range_id", "full")
                 .withColumn("total_all", F.max("total").over(_all()))
                 .where(F.col("range_label").isNotNull()))
    return joined.select(
        "range_id", "range_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.round(F.try_divide(F.coalesce("n", F.lit(0)) * 100.0, F.col("total_all")), 2).alias("pct"))


def duration_range(df: DataFrame, col: str) -> DataFrame:
    """Minimum and maximum duration, maximum also in seconds and minutes."""
    d = F.col(col).try_cast("double")
    return (df.agg(F.min(d).alias("min_us"), F.max(d).alias("max_us"))
              .withColumns({"max_s": F.round(F.col("max_us") / 1_000_000, 2),
                            "max_min": F.round(F.col("max_us") / 60_000_000, 2)}))


def _present(df: DataFrame, c: str):
    """The cell, null where it is NaN."""
    col = F.col(f"`{c}`")
    return F.when(~F.isnan(col), col) if df.schema[c].dataType.simpleString() in ("double", "float") else col


def null_percentage(df: DataFrame) -> DataFrame:
    """Share of null cells per column in one pass, as rows.

    One ``count(col)`` per column plus one row count: a single buffer field per
    column keeps wide tables inside whole-stage code generation.
    """
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(_present(df, c)).alias(c) for c in df.columns])
    long = wide.unpivot(["__n"], [F.col(f"`{c}`") for c in df.columns], "column_name", "non_null")
    return long.select("column_name", F.round(F.try_divide((F.col("__n") - F.col("non_null")) * 100.0,
                                                           F.col("__n")), 6).alias("null_pct"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and repeated rows."""
    per_row = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(F.sum("n").cast("bigint").alias("n_rows"),
                       F.count(F.lit(1)).alias("n_distinct"),
                       (F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("n_duplicated"))


def match_rate(matched: DataFrame) -> DataFrame:
    """Labelled flows per matching pass and their share of all flows."""
    per = (matched.groupBy(F.coalesce(F.col("match_pass"), F.lit("none")).alias("match_pass"))
                  .agg(F.count(F.lit(1)).alias("n")))
    return per.withColumn("total", F.sum("n").over(_all())).select(
        "match_pass", "n",
        F.round(F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0), 6).alias("rate"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, and per column its type and non-null count, in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(_present(df, c)).alias(c) for c in df.columns])
    long = wide.unpivot(["__rows"], [F.col(f"`{c}`") for c in df.columns], "column_name", "non_null")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtype = F.lit(None).cast("string")
    for name, t in types.items():
        dtype = F.when(F.col("column_name") == name, F.lit(t)).otherwise(dtype)
    return long.select("column_name", dtype.alias("dtype"), "non_null", F.col("__rows").alias("n_rows"))
