"""Benchmark decontamination as a prefix-filtered containment join of word windows.

A window is 13 consecutive words of an item (the whole item if it has fewer). A document must
contain all words of a window in order, so by the prefix-filter principle for full
containment one necessary token is enough: the window's rarest word, by its number of
documents over the whole table. Only documents' occurrences of such words become candidates;
the word's offset in the window bounds the position, the window's length bounds the room,
and the window-sized slice of the document is compared exactly.

The benchmark is a stated query set: it is read in blocks of at most ``BLOCK_CHARS``
characters, each sent to the tasks, so a benchmark of any size is searched whole and what is
sent has a fixed bound. Documents are never shuffled.

Cases: null text has no words (never contaminated); items without words have no windows; items without
an id hit words and together count as one item, which no list names;
repeated items or ids count once; empty tables give an empty result or no hits; other
columns of the documents are carried along untouched where the rows are kept.
"""
from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, sha256_hex, texts

WINDOW, SHARE, BLOCK_CHARS = 13, 20, 32_000_000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all non-ASCII characters."""
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


def windows(item: list[bytes], size: int) -> list[tuple]:
    if not item:
        return []
    return [tuple(item[i:i + size]) for i in range(max(1, len(item) - size + 1))]


def document_counts(docs: DataFrame, vocabulary: set) -> dict:
    """Number of documents with each word of ``vocabulary``; the result has at most its size."""
    vocabulary = frozenset(vocabulary)

    def run(batches):
        n = Counter()
        for b in batches:
            for t in b["text"]:
                n.update(vocabulary.intersection(words(t)))
        yield pd.DataFrame({"w": list(n), "n": list(n.values())})
    got = texts(docs).select("text").mapInPandas(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in got.collect()}


def search(docs: DataFrame, block: list[tuple], size: int = WINDOW, keep: bool = False) -> DataFrame:
    """Matches of one block of (item_id, text): n_words, covered word ranges and items per document."""
    grams = defaultdict(set)
    for item_id, text in block:
        for g in windows(words(text or ""), size):
            grams[g].add(None if item_id is None else str(item_id))
    df = document_counts(docs, {w for g in grams for w in g})
    places = defaultdict(set)  # rarest word of a window -> (its offset, window length)
    for g in grams:
        if all(w in df for w in g):  # a word of no document: the window can't occur
            rare = min(g, key=lambda w: (df[w], w))
            places[rare].add((g.index(rare), len(g)))
    table = {b" ".join(g): tuple(i) for g, i in grams.items()}
    places = {w: tuple(p) for w, p in places.items()}

    def make():
        def one(text):
            ws, spans, items = words(text), [], set()
            for at, w in enumerate(ws):
                for off, length in places.get(w, ()):
                    lo = at - off
                    if lo >= 0 and lo + length <= len(ws):
                        found = table.get(b" ".join(ws[lo:lo + length]))
                        if found:
                            spans.append((lo, lo + length))
                            items.update(found)
            return len(ws), merged(spans), sorted(items, key=lambda i: (i is None, i))

        def f(_, text):
            got = [one(t) for t in text]
            return [[g[0] for g in got], [[x for s in g[1] for x in s] for g in got], [g[2] for g in got]]
        return f

    def typed():
        f = make()
        return lambda ids, text: [pa.array(c, t) for c, t in zip(f(ids, text), (
            pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))]
    return annotate(docs, typed, "n_words long, hit_ranges array<bigint>, items array<string>", keep)


def merged(spans: list) -> list:
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks(benchmark: DataFrame):
    """The benchmark in blocks of about ``BLOCK_CHARS`` characters, each collected on its own."""
    bench = benchmark.select("item_id", "text")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    for i in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in part.collect()]


def _judge(df: DataFrame) -> DataFrame:
    share = SHARE

    @F.pandas_udf("n_hit long, n_items long, items_sha256 string")
    def judge(ranges: pd.Series, items: pd.Series) -> pd.DataFrame:
        hits = [sum(e - s for s, e in merged(list(zip(r[::2], r[1::2])))) for r in ranges]
        ids = [set(i) for i in items]
        return pd.DataFrame({"n_hit": hits, "n_items": [len(i) for i in ids],
                             "items_sha256": [sha256_hex(",".join(sorted(i - {None})).encode()) for i in ids]})
    out = df.withColumn("_j", judge("hit_ranges", "items"))
    return (out.withColumn("n_hit", F.col("_j.n_hit")).withColumn("n_items", F.col("_j.n_items"))
            .withColumn("items_sha256", F.col("_j.items_sha256")).drop("_j")
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: bool = False) -> DataFrame:
    """Per document n_words, hit_ranges, items, n_hit, n_items, items_sha256 and contaminated.

    ``keep``: the whole row of ``docs`` is in the struct column ``row`` instead of ``doc_id``.
    """
    out = None
    narrow = docs if keep else texts(docs)
    for block in blocks(benchmark):
        if out is None:
            out = search(narrow, block, size, True)
            continue
        # a further block: the earlier findings ride along in the row
        before = out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"),
                            F.struct("row", "hit_ranges", "items").alias("before"))
        out = search(before, block, size, True).select(
            F.col("row.before.row").alias("row"), "n_words",
            F.concat("row.before.hit_ranges", "hit_ranges").alias("hit_ranges"),
            F.concat("row.before.items", "items").alias("items"))
    out = out if keep else out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "hit_ranges", "items")
    return _judge(out)
