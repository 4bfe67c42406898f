"""Documents dealt once into slabs, so that tasks can exchange compact arrays about them.

A slab is a set of whole documents of about ``SLAB_BYTES`` text bytes, chosen by a hash of id, text
and row, so that copies of one row are dealt out too. The slabs are written as one bucketed table in the shared folder, with
several slabs a bucket where there are more than Spark's limit of buckets; later passes
read each slab where it lies (the scan keeps the table's partitioning, only the much smaller
answers are shuffled to it). Inside a slab, texts are one byte string with document ends.
"""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import shared_dir

from .common import texts, width

SLAB_BYTES = 8 << 20
#: Stands for a null id in arrays; sorts after every id.
NULL_ID = np.iinfo(np.int64).max


def zip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unzip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def deal(docs: DataFrame, slab_bytes: int = SLAB_BYTES) -> tuple[DataFrame, int]:
    """The slab table (slab, ids, lens, text as compressed arrays; several rows a slab) and the number of slabs."""
    spark = docs.sparkSession
    src = texts(docs)
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = width(spark, total, slab_bytes)

    def pack(batches):
        for b in batches:
            for slab, g in b.groupby("slab", sort=True):
                raw = [t.encode("utf-8", "replace") for t in g["text"]]
                ids = g["doc_id"].astype("Int64").fillna(NULL_ID).to_numpy(np.int64)
                text = b"".join(raw)
                yield pd.DataFrame({"slab": [slab], "key": [xxhash.xxh64_intdigest(text + ids.tobytes()) >> 1],
                                    "ids": [ids.tobytes()], "lens": [np.array([len(r) for r in raw], "<i8").tobytes()],
                                    "text": [zip_bytes(text)]})
    row = F.monotonically_increasing_id()  # the same whenever a split of the input is read again
    packed = src.withColumn("slab", F.pmod(F.xxhash64("doc_id", "text", row), F.lit(n)).cast("long")).mapInPandas(
        pack, "slab long, key long, ids binary, lens binary, text binary")
    name = f"slabs_{uuid.uuid4().hex}"
    buckets = min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    (packed.repartition(buckets, "slab").write.format("parquet").bucketBy(buckets, "slab")
     .option("compression", "uncompressed").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name), n


class Slab:
    """One slab: ``ids``, document ``starts`` and ``ends`` in ``data``; the same order in every pass."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("key")
        self.slab = int(pdf["slab"].iloc[0])
        self.ids = np.frombuffer(b"".join(pdf["ids"]), np.int64)
        lens = np.frombuffer(b"".join(pdf["lens"]), np.int64)
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.data = b"".join(map(unzip_bytes, pdf["text"]))


def each_slab(table: DataFrame, fn, schema: str, answers: DataFrame | None = None) -> DataFrame:
    """``fn(slab, answers of the slab) -> data frame`` for every slab."""
    if answers is None:
        def alone(pdf):
            return fn(Slab(pdf), None)
        return table.groupBy("slab").applyInPandas(alone, schema)

    def both(left, right):
        return fn(Slab(left), right)
    return table.groupBy("slab").cogroup(answers.groupBy("slab")).applyInPandas(both, schema)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit hashes by their leading bits: sorted hashes have sorted buckets."""
    return ((h >> np.uint64(40)).astype(np.int64) * n) >> 24


def cut(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    if not len(bucket):
        return []
    s = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[s].tolist(), s.tolist(), [*s[1:].tolist(), len(bucket)]))
