"""Phrase collocations from a weighted de Bruijn graph of word four-grams, per language.

* *Edges*: each word occurrence counts its longest gram, the four words from it on, or fewer where its piece
  ends. A four-gram is an edge from the node of its first three words to that of its last three. Tasks count
  chunks of text first (a frequent gram leaves a chunk once) and send them by a hash of language and node, packed: one row
  holds a chunk's grams of one part as sorted word numbers beside the words themselves, about 5 bytes
  a gram where plain rows take 30. A chunk never sends more rows than it has grams.
* *Shorter counts* come from flow, without a second look at the text: f(three words) is what flows out of
  the node plus the pieces that end there, f(two words) is the flow of the nodes that begin with them
  plus the pieces that end with them (a second, smaller exchange of the same kind), and so on to words and
  the total. Edges and nodes under ``min_count`` matter as flow only and are not kept.
* *Paths*: the remaining edges are compacted; a node with one such edge in and one out lies inside a path. Edges
  find their path's head by pointer doubling (log2 of the longest path rounds of joins on written tables;
  a closed ring is cut at its smallest edge), and blocks of ``BLOCK`` edges become one row with
  their words, edge counts and node flows, from which the four-word candidates and their three-word parts are read.
* A candidate is scored by its weakest cut and dropped where a longer one explains it; for a node that is its
  largest edge, for two words their largest node.

A task holds a chunk of ``CHUNK`` bytes of text or one longer text, a part of about ``PART`` bytes (less where grams
repeat; a node's edges are in one part, at most one for each word and chunk), or a block of a path.

Cases: null and empty texts have no words; a null language is ``und``; null or repeated ids don't matter,
every row counts; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, width
from .slabs import cut, unzip_bytes, zip_bytes
from .components import components

MIN_COUNT, TOP, COVER = 30, 2000, 80
CHUNK, PART, BLOCK, SALTS = 10 << 20, 10 << 20, 1024, 64
# A piece ends at any of .,;:!? and \x0A-\x0D, here all a full stop; after that the only blanks are spaces.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")


_ROW = "part int, lang string, grams binary"
_FOUND = f"{_ROW}, phrase string, next string, n long"


def _hash(lang: str, vocab: list, words: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of ``words`` (numbers into ``vocab``), the same in every task."""
    import xxhash
    code = np.array([xxhash.xxh64_intdigest(w) for w in vocab], np.uint64)
    h = np.full(len(words), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ code[words[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def pack(lang: str, vocab: list, words: np.ndarray, n: np.ndarray, by: int, parts: int) -> list[dict]:
    """Rows (part, lang, grams) of counted grams; the part is a hash of language and first ``by`` words."""
    v, m = len(vocab), words.shape[1]
    part = (_hash(lang, vocab, words[:, :by]) % np.uint64(parts)).astype(np.int64)
    wide = words.astype(np.int64)
    first = wide[:, 0] * v + wide[:, 1]
    keys = (first, part) if m == 2 else (wide[:, 2] * v + wide[:, 3], first, part)
    if parts * v * v < 1 << 62:  # part and first words as one number
        keys = (*keys[:-2], part * (v * v) + first)
    order = np.lexsort(keys)
    words, n, part = words[order], n[order], part[order]
    out = []
    for p, s, e in cut(part):
        cells = words[s:e].T  # columns one after the other: sorted runs stay together
        if 4 * cells.size > v:
            used = np.flatnonzero(np.bincount(cells.ravel(), minlength=v))
            place = np.zeros(v, np.int64)
            place[used] = np.arange(len(used))
            local = place[cells]
        else:
            used, local = np.unique(cells, return_inverse=True)
        kind = "<u2" if len(used) < 1 << 16 else "<u4"
        body = b"\n".join([vocab[i] for i in used.tolist()])
        data = (np.array([e - s, len(used), len(body)], "<i8").tobytes() + body + local.reshape(m, e - s).astype(kind).tobytes()
                + n[s:e].astype("<i8").tobytes())
        out.append({"part": p, "lang": lang, "grams": zip_bytes(data)})
    return out


def unpack(rows: list, m: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(words, grams as numbers, counts) of several packed rows laid together; word 0 is no word."""
    code: dict = {b"": 0}
    grams, counts = [], []
    for r in rows:
        data = unzip_bytes(r)
        n, v, size = np.frombuffer(data, "<i8", 3).tolist()
        to = np.array([code.setdefault(w, len(code)) for w in data[24:24 + size].split(b"\n")], np.int32)
        kind = np.dtype("<u2" if v < 1 << 16 else "<u4")
        at = 24 + size
        grams.append(to[np.frombuffer(data, kind, m * n, at).reshape(m, n).T])
        counts.append(np.frombuffer(data, "<i8", n, at + m * n * kind.itemsize))
    return list(code), np.concatenate(grams), np.concatenate(counts)


def _add(grams: np.ndarray, n: np.ndarray, v: int, lengths) -> dict:
    """For beginnings of each of ``lengths`` words: (place of one gram with each distinct one, sum of their counts)."""
    import pandas as pd

    out, key = {}, np.zeros(len(grams), np.int64)
    for j in range(grams.shape[1]):
        key, u = pd.factorize(key * v + grams[:, j])
        if j + 1 in lengths:
            at = np.empty(len(u), np.int64)
            at[key[::-1]] = np.arange(len(key))[::-1]
            # sums in doubles are exact below 2^53
            out[j + 1] = at, np.bincount(key, n, len(u)).astype(np.int64)
    return out


def count(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """(words, distinct longest grams as four numbers, counts) of texts; 0 stands after the end of a piece."""
    import pandas as pd

    code = {b".": 0}
    tokens = b".".join(texts).translate(_LOWER).replace(b".", b" . ").split()
    ids = np.array([code.setdefault(t, len(code)) for t in tokens], np.int32)
    del tokens
    v, w = len(code), [ids]
    for k in (1, 2, 3):
        w.append(np.where(w[-1] > 0, np.concatenate([ids[k:], np.zeros(min(k, len(ids)), np.int32)]), 0))
    grams = np.stack([x[ids > 0] for x in w], axis=1)
    del w, ids
    wide = [grams[:, j].astype(np.int64) for j in range(4)]
    head, _ = pd.factorize(wide[0] * v + wide[1])
    tail, kinds = pd.factorize(wide[2] * v + wide[3])
    del wide
    key, u = pd.factorize(head * max(1, len(kinds)) + tail)
    at = np.empty(len(u), np.int64)
    at[key[::-1]] = np.arange(len(key))[::-1]
    return [b"", *list(code)[1:]], grams[at], np.bincount(key, minlength=len(u))


def edges(docs: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """(part, lang, grams): longest grams counted by chunks of text, packed by node."""
    import pyarrow as pa

    def run(batches):
        held, size = {}, 0

        def flush():
            for lang, texts in held.items():
                rows = pack(lang, *count(texts), 3, parts)
                for lo in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[lo:lo + 1000], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("grams", pa.binary())])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                held.setdefault(lang, []).append(t)
                size += len(t)
                if size >= chunk:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    src = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, _ROW)


def _flow(packed: DataFrame, m: int, parts: int, min_count: int) -> DataFrame:
    """One level of flow over packed grams of ``m`` words dealt by part.

    m = 4: frequent edges (phrase, next, n), frequent nodes (phrase, n) and the packed flow of word pairs.
    m = 2: frequent pairs (phrase, n) and all words (next, n), not added up over parts.
    """
    import pyarrow as pa

    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("grams", pa.binary()), ("phrase", pa.string()),
                        ("next", pa.string()), ("n", pa.int64())])

    def solve(lang, rows):
        vocab, grams, n = unpack(rows, m)
        levels = _add(grams, n, len(vocab), (2, 3, 4) if m == 4 else (1, 2))
        text = [w.decode("utf-8", "replace") for w in vocab]

        def frequent(length):
            at, total = levels[length]
            ok = (total >= min_count) & (grams[at, length - 1] > 0)
            return zip(grams[at[ok]].tolist(), total[ok].tolist())
        if m == 4:
            yield from ({"lang": lang, "phrase": " ".join(text[i] for i in g[:3]), "next": text[g[3]], "n": k}
                        for g, k in frequent(4))
            yield from ({"lang": lang, "phrase": " ".join(text[i] for i in g[:3]), "n": k} for g, k in frequent(3))
            at, total = levels[2]
            yield from pack(lang, vocab, grams[at, :2], total, 2, parts)
        else:
            yield from ({"lang": lang, "phrase": " ".join(text[i] for i in g), "n": k} for g, k in frequent(2))
            at, total = levels[1]
            yield from ({"lang": lang, "next": text[i], "n": k} for i, k in zip(grams[at, 0].tolist(), total.tolist()))

    def run(batches):
        key, held = None, []

        def flush():
            rows = list(solve(key[1], held)) if held else []
            for lo in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist([{"part": None, "grams": None, "phrase": None, "next": None, "n": None, **r}
                                                  for r in rows[lo:lo + 5000]], schema=schema)
        for b in batches:
            for p, lang, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (p, lang) != key:
                    yield from flush()
                    key, held = (p, lang), []
                held.append(g.as_py())
        yield from flush()

    return packed.repartition(parts, "part").sortWithinPartitions("part", "lang").mapInArrow(run, _FOUND)


def graph(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """From written tables: frequent edges (lang, node, next, n), flows of three, two and one words, words per language."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = width(docs.sparkSession, total, PART)
    nodes = materialize(_flow(edges(docs, parts), 4, parts, min_count), "phrase-nodes")
    pairs = materialize(_flow(nodes.where(F.col("grams").isNotNull()).select("part", "lang", "grams"), 2, parts, min_count),
                        "phrase-pairs")
    one = materialize(pairs.where(F.col("next").isNotNull()).groupBy("lang", F.col("next").alias("phrase")).agg(
        F.sum("n").alias("n")), "phrase-words")

    def grams(src, alone):
        return src.where(F.col("phrase").isNotNull() & (F.col("next").isNull() if alone else F.col("next").isNotNull()))
    return (grams(nodes, False).select("lang", F.col("phrase").alias("node"), "next", "n"),
            grams(nodes, True).select("lang", "phrase", "n"), grams(pairs, True).select("lang", "phrase", "n"),
            one.where(F.col("n") >= min_count), one.groupBy("lang").agg(F.sum("n").alias("total")))


def _doubled(links: DataFrame) -> tuple[DataFrame, int]:
    """(id, pred or null) to (id, at, dist, open): the head of each id's chain and the steps to it; open: on a ring."""
    s = materialize(links.select("id", F.coalesce("pred", "id").alias("at"), F.col("pred").isNotNull().cast("long").alias("dist"),
                                 F.col("pred").isNotNull().alias("open")), "phrase-chain")
    left = s.where("open").count()
    while left:
        t = s.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("dist").alias("dist2"), F.col("open").alias("open2"))
        s = materialize(s.where("NOT open").union(s.where("open").join(t, "at").select(
            "id", F.col("at2"), F.col("dist") + F.col("dist2"), "open2")), "phrase-chain")
        before, left = left, s.where("open").count()
        if left == before:  # every round closes some edge of every open chain: only rings are left
            break
    return s, left


def chains(links: DataFrame) -> DataFrame:
    """(id, pred or null), each pred once, to (id, at, dist): rings are cut at their smallest id."""
    s, rings = _doubled(links)
    done = s.where("NOT open").select("id", "at", "dist")
    if not rings:
        return done
    ring = materialize(links.join(s.where("open").select("id"), "id", "left_semi"), "phrase-rings")
    root = components(ring.select(F.col("id").alias("a"), F.col("pred").alias("b"))).select(F.col("node").alias("id"), "root")
    cut = ring.join(root, "id", "left").select("id", F.when(F.col("id") != F.coalesce("root", "id"), F.col("pred")).alias("pred"))
    return done.union(_doubled(cut)[0].select("id", "at", "dist"))


def paths(frequent: DataFrame, three: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Compacted paths (lang, path, block, words, counts, flows) and the nodes (lang, phrase, n, longer).

    ``counts`` has one entry for each four words of ``words``, ``flows`` one for each three; ``longer`` is the
    node's largest edge.
    """
    e = materialize(frequent.select(F.monotonically_increasing_id().alias("id"), "lang", F.col("node").alias("tail"), F.concat_ws(
        " ", F.expr("substring(node, instr(node, ' ') + 1)"), "next").alias("head"), "next", "n"), "phrase-edges")
    none = F.lit(None).cast("long")
    ends = e.select("lang", F.col("tail").alias("phrase"), F.col("id").alias("out"), none.alias("into"), "n").union(
        e.select("lang", "head", none, "id", "n"))
    degree = ends.groupBy("lang", "phrase").agg(F.count("out").alias("n_out"), F.count("into").alias("n_in"), F.max(
        "into").alias("pred"), F.max("n").alias("longer"))
    nodes = materialize(three.join(degree, ["lang", "phrase"], "left").select(
        "lang", "phrase", "n", "longer", F.when((F.col("n_out") == 1) & (F.col("n_in") == 1), F.col("pred")).alias("pred")),
        "phrase-flows")
    e = materialize(
        e.join(nodes.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("tail_flow"), "pred"), ["lang", "tail"])
         .join(nodes.select("lang", F.col("phrase").alias("head"), F.col("n").alias("head_flow")), ["lang", "head"]),
        "phrase-links")
    at = chains(e.select("id", "pred"))
    rows = (e.join(at, "id").groupBy("lang", F.col("at").alias("path"), F.floor(F.col("dist") / block).alias("block"))
             .agg(F.sort_array(F.collect_list(F.struct("dist", "tail", "next", "n", "tail_flow", "head_flow"))).alias("e")))
    return rows.select(
        "lang", "path", "block", F.concat(F.split(F.col("e")[0]["tail"], " "), F.col("e.next")).alias("words"),
        F.col("e.n").alias("counts"),
        F.concat(F.col("e.tail_flow"), F.slice("e.head_flow", -1, 1)).alias("flows")), nodes.drop("pred")


def _candidates(path: DataFrame, nodes: DataFrame, two: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, longer, head3, tail3): phrases of m words; for four words the flows of their two nodes."""
    none = F.lit(None).cast("long")
    four = path.select("lang", "words", "flows", F.posexplode("counts").alias("i", "a")).select(
        "lang", F.expr("array_join(slice(words, i + 1, 4), ' ')").alias("phrase"), F.lit(4).alias("m"), "a", none.alias("longer"),
        F.expr("flows[i]").alias("head3"), F.expr("flows[i + 1]").alias("tail3"))
    three = nodes.select("lang", "phrase", F.lit(3), F.col("n"), "longer", none, none)
    inside = nodes.select("lang", "n", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index(
        "phrase", " ", -2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    pairs = two.join(inside, ["lang", "phrase"], "left").select("lang", "phrase", F.lit(2), F.col("n"), "longer", none, none)
    return four.union(three).union(pairs)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (and cut: the words before the weakest cut): the best of each language."""
    frequent, three, two, one, totals = graph(docs, min_count)
    path, nodes = paths(frequent, three)
    c = _candidates(materialize(path, "phrase-paths"), nodes, two)
    big = "cast({} as decimal(20,0))"
    c = materialize(c.where(f"longer IS NULL OR {big.format('longer')} * 100 < {big.format('a')} * {cover}").withColumns({
        "w1": F.substring_index("phrase", " ", 1), "w2": F.substring_index("phrase", " ", -1),
        "b1": F.substring_index("phrase", " ", 2), "b2": F.substring_index("phrase", " ", -2)}), "phrase-candidates")
    for key, table in (("w1", one), ("w2", one), ("b1", two), ("b2", two)):
        c = c.join(table.select("lang", F.col("phrase").alias(key), F.col("n").alias(f"f_{key}")), ["lang", key])

    def cut(k, left, right):
        return (f"named_struct('score', ({big.format('a')} * 2000000) div ({big.format(left)} + {big.format(right)}), "
                f"'k', {k}, 'l', {left}, 'r', {right})")
    cuts = {2: [cut(1, "f_w1", "f_w2")], 3: [cut(1, "f_w1", "f_b2"), cut(2, "f_b1", "f_w2")],
            4: [cut(1, "f_w1", "tail3"), cut(2, "f_b1", "f_b2"), cut(3, "head3", "f_w2")]}
    best = F.expr("array_min(CASE m " + " ".join(f"WHEN {m} THEN array({', '.join(x)})" for m, x in cuts.items()) + " END)")
    c = c.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each share of a language first, so that no task orders a whole language
    c = c.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return c.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"),
                                         F.col("score").cast("long").alias("score"), F.col("k").cast("long").alias("cut"))


#: DuckDB: the grams of every length counted straight from the texts.
ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS piece FROM t),
s AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(generate_series(1, len(w))) AS i, w FROM s),
o AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM g, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 30),
tot AS (SELECT lang, count(*) AS n FROM o WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT c.*, unnest(generate_series(1, m - 1)) AS k FROM c),
q AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r,
             CAST((CAST(2000000 AS HUGEINT) * k.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
             JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase
        FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS j) WHERE j < m AND i + j - 1 <= m),
cov AS (SELECT lang, phrase, max(a) AS longer FROM sub GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN cov USING (lang, phrase)
      WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score, cut FROM (
  SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a, l, r, n, score, k AS cut FROM z JOIN tot ON tot.lang = z.lang) WHERE rank <= 2000
"""
