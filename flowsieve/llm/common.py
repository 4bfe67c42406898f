"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import apply_runtime_defaults, materialize, ship_package

__all__ = ["materialize", "prepare", "load", "texts", "width", "sha256_hex", "crc_mod", "lowest"]


def prepare(spark: SparkSession) -> None:
    """Session settings and the package on the Python workers."""
    apply_runtime_defaults(spark)
    ship_package(spark)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null read as empty) alone, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def width(spark: SparkSession, amount: float, per_task: float) -> int:
    """Number of partitions for ``amount`` units at ``per_task`` units each, never below the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / per_task), 1)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo ``n`` (null id: null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def lowest(df: DataFrame, h: str, n: int) -> DataFrame:
    """The rows of ``df`` under the smallest power of two that leaves ``n`` hashes ``h`` (longs), or all.

    A top-n alone takes n rows from every partition to one place, which grows with the table;
    after this filter there are about n to 2 n rows in all. 64 counts reach the driver.
    """
    level = F.length(F.bin(F.col(h).bitwiseXOR(F.lit(-1 << 63))))
    seen = 0
    for row in df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy("level").collect():
        seen += row["n"]
        if seen >= n:
            return df.where(level <= row["level"])
    return df


def annotate(docs: DataFrame, make, fields: str, keep: bool = False) -> DataFrame:
    """Columns computed from each row's whole text, in Arrow batches, no shuffle.

    ``make()`` runs once per task and returns ``f(ids, texts) -> list of columns`` for
    ``fields``. With ``keep`` the whole input row stays in a struct column ``row``, so no name
    can clash; else only ``doc_id`` is kept. Null texts arrive as empty strings.
    """
    import pyarrow as pa

    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    if keep:
        base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        schema = f"row {base.schema['row'].dataType.simpleString()}, {fields}"
    else:
        base, schema = texts(docs), f"doc_id long, {fields}"

    def run(batches):
        f = make()
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), 2000):
                batch = whole.slice(lo, 2000)
                if keep:
                    row = batch.column(0)
                    ids, text = row.field("doc_id"), row.field("text")
                    head = [row]
                else:
                    ids, text = batch.column(0), batch.column(1)
                    head = [ids]
                cols = f(ids.to_pylist(), [t or "" for t in text.to_pylist()])
                yield pa.RecordBatch.from_arrays([*head, *map(pa.array, cols)],
                                                 names=["row" if keep else "doc_id", *names])
    return base.mapInArrow(run, schema)
