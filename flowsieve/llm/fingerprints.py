"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (lines, cut again at sentence ends, trimmed). Each
paragraph hashes to a wide vector; the fingerprint is the sum of the vectors: 64 lanes of +-1
modulo 2**32 (read with sign) and two lanes of 64 random bits modulo 2**64. Sums commute, so order does not
matter, and a paragraph is inserted or deleted by adding or subtracting its vector. The two
wide lanes decide equality; the squared lengths of the sign lanes estimate how many
paragraphs two fingerprints differ in, which gives their likeness.

``with_neighbours`` compares each document with the next by ascending id (after the last the
first). Documents are range-partitioned and sorted by id once; each task walks its range
with one document in hand and passes only its first and last document on, so that the ends of
neighbouring ranges meet in a join of one row per range.

Cases: null text is empty text (no paragraphs, the zero fingerprint; two empty texts are
alike 1.0); equal ids are ordered by text; null ids come first; a single document is its own
next; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sha256_hex, texts

LANES = 64
_ENDS = re.compile(r"\n+|(?<=[.!?])\s+")


def paragraphs(text: str) -> list[bytes]:
    return [p.encode("utf-8", "replace") for p in map(str.strip, _ENDS.split(text)) if p]


class Fingerprint:
    """Sum of paragraph vectors; ``insert`` and ``delete`` take paragraphs (bytes)."""

    __slots__ = ("signs", "wide")

    def __init__(self):
        self.signs, self.wide = np.zeros(LANES, np.uint32), np.zeros(2, np.uint64)

    def _add(self, parts: list[bytes], sign: int):
        for lo in range(0, len(parts), 1 << 16):
            some = parts[lo:lo + (1 << 16)]
            h = np.array([(xxhash.xxh64_intdigest(p, 1), xxhash.xxh64_intdigest(p, 2), xxhash.xxh64_intdigest(p, 3))
                          for p in some], np.uint64)
            ones = np.unpackbits(h[:, 0].copy().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            self.signs = self.signs + (sign * (2 * ones - len(some))).astype(np.uint32)
            total = h[:, 1:].sum(axis=0, dtype=np.uint64)
            self.wide = self.wide + total if sign > 0 else self.wide - total
        return self

    def insert(self, parts: list[bytes]):
        return self._add(parts, 1)

    def delete(self, parts: list[bytes]):
        return self._add(parts, -1)

    def key(self) -> str:
        return self.wide.tobytes().hex() + self.signs.tobytes().hex()


def of(text: str) -> Fingerprint:
    return Fingerprint().insert(paragraphs(text))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1.0 for equal fingerprints, else the estimated share of common paragraphs (below 1)."""
    if (a.wide == b.wide).all():
        return 1.0
    x, y, d = (v.view(np.int32).astype(np.float64) for v in (a.signs, b.signs, a.signs - b.signs))
    both = (x * x).sum() + (y * y).sum()
    return float(min(0.999, max(0.0, 1.0 - (d * d).sum() / both))) if both else 0.0


def edited(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + nxt[:half]


_ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
_COLS = [c.split()[0] for c in _ROW.split(", ")]


def _compare(i, text, fp, nxt, nxt_fp):
    e = edited(text, nxt)
    ef = of(e)
    return (i, len(text), sha256_hex(e.encode("utf-8", "replace")), fp.key(), ef.key(),
            likeness(fp, ef), likeness(fp, nxt_fp))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likeness (see the module)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def walk(batches):
        here, first, held = TaskContext.get().partitionId(), None, None
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                fp = of(t)
                if held is None:
                    first = (i, t)
                else:
                    out.append(_compare(*held, t, fp) + (None, None, None, None))
                held = (i, t, fp)
            yield frame(out)
        if held is not None:
            yield frame([(held[0],) + (None,) * 6 + (here, first[0], first[1], held[1])])

    def frame(rows):
        df = pd.DataFrame(rows, columns=[*_COLS, "part", "first_id", "first_text", "last_text"])
        return df.astype({"doc_id": "Int64", "n_chars": "Int64", "part": "Int64", "first_id": "Int64"})

    done = materialize(dealt.mapInPandas(
        walk, _ROW + ", part long, first_id long, first_text string, last_text string"), "fingerprints")
    ends = done.where("part is not null").select("part", "doc_id", "first_text", "last_text")
    order = Window.orderBy("part")  # one row of two numbers for each range
    nxt = ends.select("part").select(F.col("part").alias("p"), F.lead("part").over(order).alias("q"),
                                     F.min("part").over(Window.partitionBy()).alias("lowest"))
    nxt = materialize(nxt.select("p", F.coalesce("q", "lowest").alias("q")), "ranges")
    pairs = ends.join(nxt, ends.part == nxt.p).select("doc_id", "last_text", "q").join(
        ends.select(F.col("part").alias("r"), "first_text"), F.col("q") == F.col("r")).select(
        "doc_id", "last_text", "first_text")

    def meet(batches):
        for b in batches:
            yield pd.DataFrame([_compare(i, t, of(t), x, of(x)) for i, t, x in
                                zip(b["doc_id"].astype("Int64"), b["last_text"], b["first_text"])],
                               columns=_COLS).astype({"doc_id": "Int64", "n_chars": "Int64"})
    return done.where("part is null").select(*_COLS).union(pairs.mapInPandas(meet, _ROW))
