"""Packing documents into sequences: first-fit decreasing over a tournament tree.

Documents are tokenised whole and cut into pieces of at most ``size`` tokens; pieces are
dealt into randomised groups of documents (a hash of id, text and row, so that copies of one row
spread too) of about ``GROUP_DOCS`` documents, and each group is packed on its own: longest piece first, into the leftmost open
sequence with room, which a tournament tree of remaining capacities finds in log time. The
number of groups follows the number of documents, so a task's work does not grow.

Cases: null text is empty text (one piece: the end token alone); repeated rows are packed
each; a null id is an id like any other; an empty table gives an empty result; other columns
are ignored.
"""
from __future__ import annotations

import base64
import functools
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

SIZE, END, GROUP_DOCS, CACHE = 1024, 0, 2000, 400_000
#: Cuts a text where the tokenizer's own pattern always cuts: before a word and its one leading space.
_CUT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Texts with these go to the tokenizer whole: special tokens, and separators that only Python counts as space.
_ODD = re.compile("<\\||[\x1c-\x1f]")


class _Pieces(dict):
    """Token ids (little-endian bytes) by piece of text; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        ids = np.array(self.encode(piece), "<u4").tobytes()
        self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(folder: str | None = None):
    """``encode(text) -> ids as little-endian uint32 bytes`` of the byte-level BPE vocabulary.

    ``folder`` holds the vocabulary files (default: the installed package ``public_tokenizers``).
    Pieces are encoded by the rank file of the same vocabulary; texts with special-token
    strings by the tokenizer file itself.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    def at(name):
        return os.path.join(folder, name) if folder else public.path(name)
    with open(at("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(at("byte_bpe_50k.json"))
    pieces = _Pieces(fast.encode_ordinary)

    def encode(text: str) -> bytes:
        if _ODD.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(pieces.__getitem__, _CUT.findall(text)))
    return encode


def pieces(docs: DataFrame, size: int = SIZE, folder: str | None = None) -> DataFrame:
    """Pieces of each tokenised document: doc_id, start, length, ids_crc32, doc_tokens, grp hash."""
    def run(batches):
        encode = encoder(folder)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            out = []
            for i, t, g in zip(b["doc_id"], b["text"], b["h"]):
                ids = encode(t) + end
                n = len(ids) // 4
                for s in range(0, n, size):
                    part = ids[4 * s:4 * (s + size)]
                    out.append((i, s, len(part) // 4, zlib.crc32(part), n, g))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "h"]).astype(
                {"doc_id": "Int64"})
    row = F.monotonically_increasing_id()  # the same whenever a split of the input is read again
    src = texts(docs).withColumn("h", F.xxhash64("doc_id", "text", row))
    return src.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, h long")


def first_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing: bin and offset of each length, by a tournament tree of capacities."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [size] * (2 * leaves)  # node i: most room in its subtree
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        need = int(lengths[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, size - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, size: int = SIZE, group_docs: int = GROUP_DOCS, folder: str | None = None) -> DataFrame:
    """One row per piece with its sequence_id and offset; sequences of a group are numbered from group * 2**32."""
    n_groups = max(1, -(-docs.count() // group_docs))

    def one(pdf):
        pdf = pdf.sort_values(["doc_id", "h", "start"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit(pdf["length"].to_numpy(), size)
        pdf["sequence_id"], pdf["offset"] = pdf["grp"] * (1 << 32) + bins, offsets
        return pdf.drop(columns=["grp", "h"])
    grouped = pieces(docs, size, folder).withColumn("grp", F.pmod("h", F.lit(n_groups)))
    return grouped.groupBy("grp").applyInPandas(
        one, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
