"""Near-duplicates by shingle sets: fast similarity sketching, banding, exact verification.

* *Sketch*: ``T`` coordinates in rounds. In round i < T each shingle of a set is thrown into one hashed bin with a
  value between i and i + 1; in round T + j all shingles go to bin j. A coordinate keeps its smallest
  value, and a set stops after the round that fills its last bin, so every coordinate is filled after at most
  2 T rounds (mostly one or two) and equal coordinates of two sets concentrate around their
  similarity like those of T independent functions.
* Documents of equal sets are one *class*; only classes are compared.
* *Banding*: ``T / ROWS`` bands. Two sets of similarity s miss each other in all of them with
  probability (1 - s^ROWS)^(T / ROWS): 6e-11 at the threshold, less above.
* *Cells*: the classes of a bucket meet at its centre, their smallest class; buckets of one centre form one cell, so
  a class is once in a cell however many bands it shares. All pairs of a class and its centre are verified on
  their full sets, from the texts, which also gives the class as a difference from its centre (hashed shingles
  that only one of them has). Links make components.
* Where a cell's classes are still in several components, the other pairs are verified as well, in blocks of
  ``BLOCK`` classes, exactly and without the texts: |x and y| = |centre| - |centre \\ x| - |centre \\ y| + |Dx and Dy| with
  the differences D, the last term for a whole block by matrix products. Only links leave a task, one for
  two components. So no link is lost, and neither finished groups nor near misses are expanded into rows.
* A centre with one other class has no more pairs: there, sets whose sketches agree in fewer coordinates than
  a true link leaves but once in 1e10 (Chernoff's bound) are not verified.

Counts before joins are written tables, so AQE can split hot cells; a task holds some texts, or two blocks of differences.

Cases: null text is empty text; a document without words is linked with nothing and its own component; a null id is
larger than every id, a component of null ids has a null id and all its rows are kept; rows of the same id are
compared like others; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts
from .components import components

SHINGLE, PERCENT = 3, 85
T, ROWS, BLOCK, COLUMNS = 128, 4, 2048, 1024
MISS = 1e-10
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


def _seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def hashed_sets(docs: list, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of every distinct shingle, by document and hash."""
    import pandas as pd
    import xxhash

    code: dict = {b"": 0}
    size, flat = [], []
    for t in docs:
        w = t.translate(_LOWER).split()
        if w and len(w) < k:
            w += [b""] * (k - len(w))  # no word is empty: a short text's only shingle
        flat.extend([code.setdefault(x, len(code)) for x in w])
        size.append(len(w))
    ids, v = np.array(flat, np.int64), len(code)
    n = np.maximum(np.array(size) - k + 1, 0)
    doc = np.repeat(np.arange(len(docs)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
    word = np.array([xxhash.xxh64_intdigest(x, 7) for x in code], np.uint64)
    gram = ids[first]
    h = _mix(word[gram])
    for j in range(1, k):
        gram = pd.factorize(gram * v + ids[first + j])[0]  # exact number of the words so far
        h = _mix(h + word[ids[first + j]])
    _, at = np.unique(doc * (int(gram.max()) + 1 if len(gram) else 1) + gram, return_index=True)
    doc, h = doc[at], h[at]
    order = np.lexsort((h, doc))
    return doc[order], h[order]


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int, t: int = T) -> np.ndarray:
    """The coordinates (n_docs, t) of hashed sets; those of an empty set stay at the largest value."""
    empty = np.uint64((1 << 64) - 1)
    s = np.full(n_docs * t, empty)
    open_ = np.zeros(n_docs, bool)
    open_[doc] = True
    for i in range(2 * t):
        x = _mix(h + _seed(i))
        at = doc * t + (i - t if i >= t else (x % np.uint64(t)).astype(np.int64))
        np.minimum.at(s, at, np.uint64(i) << np.uint64(55) | x >> np.uint64(9))
        rows = np.flatnonzero(open_)
        open_[rows] = (s.reshape(n_docs, t)[rows] == empty).any(axis=1)
        still = open_[doc]
        doc, h = doc[still], h[still]
        if not len(doc):
            break
    return s.reshape(n_docs, t)


def least_equal(t: int, percent: int, miss: float = MISS) -> int:
    """Coordinates that at least agree at similarity ``percent`` / 100, but for a chance of at most ``miss``."""
    s = percent / 100
    c = 0
    while c < s * t:
        q = (c + 1) / t
        kl = q * math.log(q / s) + (1 - q) * math.log((1 - q) / (1 - s)) if q < 1 else math.log(1 / s)
        if q >= s or math.exp(-t * kl) > miss:
            break
        c += 1
    return c


def sketches(docs: DataFrame, k: int = SHINGLE, t: int = T, rows: int = ROWS) -> DataFrame:
    """doc_id, text (bytes), n_shingles, class (digest of the set), bands (hashes), low (a byte of each coordinate)."""
    import pyarrow as pa

    def run(batches):
        import xxhash
        for whole in batches:
            lo, sizes = 0, [len(x.as_py() or b"") for x in whole.column(1)]
            while lo < len(sizes) or not lo:
                hi, held = lo, 0
                while hi < len(sizes) and hi - lo < 1000 and (hi == lo or held + sizes[hi] <= 4 << 20):
                    held, hi = held + sizes[hi], hi + 1
                b = whole.slice(lo, hi - lo)
                lo = max(hi, 1)
                n = b.num_rows
                doc, h = hashed_sets(b.column(1).to_pylist(), k)
                s = sketch(doc, h, n, t)
                band = np.zeros((n, t // rows), np.uint64) + np.arange(t // rows, dtype=np.uint64)[None, :]
                for j in range(rows):
                    band = _mix(band + s[:, j::rows])
                ends = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array(np.diff(ends)),
                    pa.array([xxhash.xxh3_128_digest(h[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:])], pa.binary()),
                    pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in (s & np.uint64(255)).astype(np.uint8)], pa.binary())],
                    names=["doc_id", "text", "n_shingles", "class", "bands", "low"])

    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, text binary, n_shingles long, class binary, bands array<long>, low binary")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, t: int) -> DataFrame:
    """Those pairs (a, b) whose set sizes and sketches allow a link."""
    c = least_equal(t, percent)
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("low").alias(f"low_{x}")), x)
    pairs = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(f"low_{k}").to_pylist()), np.uint8).reshape(b.num_rows, t) for k in "ab")
            keep = np.flatnonzero((x == y).sum(axis=1) >= c)
            yield b.select(["a", "b", "others"]).take(keep)
    return pairs.select("a", "b", "others", "low_a", "low_b").mapInArrow(run, "a long, b long, others long")


def _differences(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b, linked, n_a, n_b, missing, delta): both sizes, how many of b's shingles a lacks, and all that differ.

    ``delta`` is null where the cell has no ``others``. Texts are shuffled for these pairs alone.
    """
    import pyarrow as pa

    need = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "class")
    whole = materialize(rows.select("class", "text").join(need, "class").groupBy("node").agg(F.first("text").alias("text")),
                        "minhash-texts")
    for x in "ab":
        pairs = pairs.join(whole.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), x)

    def run(batches):
        last, centre = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                doc, h = hashed_sets(b.column("text_a").to_pylist(), k)
                ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
                linked, n_a, n_b, missing, delta = [], [], [], [], []
                for i, (x, others) in enumerate(zip(b.column("b").to_pylist(), b.column("others").to_pylist())):
                    if x != last:
                        last, centre = x, hashed_sets([b.column("text_b")[i].as_py()], k)[1]
                    mine = h[ends[i]:ends[i + 1]]
                    d = np.setxor1d(mine, centre, assume_unique=True)
                    both = (len(mine) + len(centre) - len(d)) // 2
                    linked.append(100 * both >= percent * (both + len(d)))
                    n_a.append(len(mine))
                    n_b.append(len(centre))
                    missing.append(len(centre) - both)
                    delta.append(d.tobytes() if others else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column("a"), b.column("b"), pa.array(linked, pa.bool_()), pa.array(n_a, pa.int64()),
                     pa.array(n_b, pa.int64()), pa.array(missing, pa.int64()), pa.array(delta, pa.binary())],
                    names=["a", "b", "linked", "n_a", "n_b", "missing", "delta"])
    return materialize(pairs.select("a", "b", "others", "text_a", "text_b").mapInArrow(
        run, "a long, b long, linked boolean, n_a long, n_b long, missing long, delta binary"), "minhash-differences")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes."""
    roots = components(links).select(F.col("node").alias("k"), F.col("root").alias("r"))
    return materialize(nodes.select("node").join(roots, F.col("node") == F.col("k"), "left").select(
        "node", F.coalesce("r", "node").alias("root")), "minhash-roots")


def common(delta: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``delta[i]`` and ``delta[j]`` (bytes of longs), for i in x and j in y, i not j."""
    import pandas as pd

    size = np.array([len(d) // 8 for d in delta])
    token = pd.factorize(np.frombuffer(b"".join(delta), np.int64))[0]
    row = np.repeat(np.arange(len(delta)), size)
    often = np.bincount(token, minlength=1)
    keep = np.flatnonzero(often[token] > 1) if len(token) else token
    token, row = pd.factorize(token[keep])[0], row[keep]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        s, e = np.searchsorted(token, [lo, lo + COLUMNS])
        m = np.zeros((len(delta), int(token[e - 1]) - lo + 1), np.float32)
        m[row[s:e], token[s:e] - lo] = 1
        out += m[x] @ m[y].T
    return out.astype(np.int64)


def _rest(cells: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between rows of one cell (b) of different components, one for two components and task."""
    import pyarrow as pa

    n = F.ceil(F.col("members") / block)
    mine = cells.withColumn("i", F.pmod(F.xxhash64("a"), n)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    dealt = (mine.select("b", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "a", "root", "n_a", "n_b",
                         "missing", "delta").repartition("b", "lo", "hi").sortWithinPartitions("b", "lo", "hi"))

    def compare(g):
        node, root, size, missing, i = (g[x].to_numpy(np.int64) for x in ("a", "root", "n_a", "missing", "i"))
        x = np.flatnonzero(i == g["lo"].iloc[0])
        y = np.flatnonzero(i == g["hi"].iloc[0])
        if not len(x) or not len(y) or (root == root[0]).all():
            return None
        both = common(g["delta"].tolist(), x, y) + g["n_b"].iloc[0] - missing[x][:, None] - missing[y][None, :]
        p, q = np.nonzero((100 * both >= percent * (size[x][:, None] + size[y][None, :] - both))
                          & (root[x][:, None] != root[y][None, :]))
        if not len(p):
            return None
        p, q = x[p], y[q]
        two = np.stack([np.minimum(root[p], root[q]), np.maximum(root[p], root[q])], axis=1)
        at = np.unique(two, axis=0, return_index=True)[1]
        return pa.RecordBatch.from_arrays([pa.array(node[p[at]]), pa.array(node[q[at]])], names=["a", "b"])

    def run(batches):
        import pandas as pd
        held = []

        def groups(p):
            key = p[["b", "lo", "hi"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            return [p.iloc[x:y] for x, y in zip(np.r_[0, cut], np.r_[cut, len(p)])]

        for b in batches:
            if b.num_rows:
                *done, last = groups(pd.concat([*held, b.to_pandas()], ignore_index=True))
                held = [last]
                yield from filter(None, map(compare, done))
        yield from filter(None, map(compare, held))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, t: int = T, rows: int = ROWS,
                    block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept: one row for each row of ``docs``."""
    table = materialize(sketches(docs, k, t, rows), "minhash-rows")
    classes = table.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("low_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    member = nodes.select("node", F.explode("bands").alias("h"))
    bucket = materialize(member.groupBy("h").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("h", "b"),
                         "minhash-buckets")
    pairs = materialize(member.join(bucket, "h").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "minhash-pairs")
    sizes = materialize(pairs.groupBy("b").agg(F.count("*").alias("members")), "minhash-cells")
    dealt = pairs.join(sizes, "b").select("a", "b", (F.col("members") - 1).alias("others"))
    dealt = materialize(_likely(dealt.where("others = 0"), nodes, percent, t).union(dealt.where("others > 0")), "minhash-verify")
    found = _differences(dealt, nodes, table, percent, k)
    links = found.where("linked").select("a", "b")
    root = _labelled(nodes, links)
    cells = found.where(F.col("delta").isNotNull()).join(root.withColumnRenamed("node", "a"), "a")
    mixed = materialize(cells.groupBy("b").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members"))
                             .where("r0 < r1").select("b", "members"), "minhash-mixed")
    root = _labelled(nodes, links.union(_rest(cells.join(mixed, "b"), percent, block)))
    of_class = root.join(nodes.select("node", "class", "low_id"), "node")
    low = of_class.groupBy("root").agg(F.min("low_id").alias("component"))
    of_class = materialize(of_class.select("class", "root").join(low, "root").select("class", "component"), "minhash-components")
    out = table.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: DuckDB: all pairs that share a shingle, counted; closure of the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
        list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i
      FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * i >= 85 * (nx + ny - i)),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.y FROM r JOIN l ON r.c = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""
