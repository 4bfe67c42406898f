"""Periodic runs, set similarity and phrases against brute force on small tables."""
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from flowsieve.llm import minhash, periodic, phrases, queries
from flowsieve.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string"
SMALL = "/root/testdata/sf0.001"
EDGE = [(None, None, None), (None, "a b", "en"), (7, "", "en"), (7, "a b c", None), (8, "a b c", "de"), (8, "A b\tc", "de"),
        (9, "é" * 30, "fr"), (10, "word " * 9000, "en"), (None, "a b c", "en"), (11, " \t\n", "en"), (12, "a\x1cb a", "en")]


@pytest.fixture(scope="module")
def sql(spark):
    prepare(spark)
    return spark


def docs_of(spark, rows):
    """Rows with extra columns whose names clash with result columns."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", score int, class string, n int").repartition(3)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


# --- periodic runs ------------------------------------------------------------------------

def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        j = 0
        while j < len(w) - q:
            k = j
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k + q - j >= max(6, 4 * q):
                found.setdefault((j, k + q), q)  # smallest period first
            j = max(k, j + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(i, words):
    mine = plain_runs(words)
    best = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if mine else (None,) * 3
    drop = {x for s, n, q in mine for x in range(s + q, s + n)}
    kept = b" ".join(w for x, w in enumerate(words) if x not in drop)
    return (i, len(mine), *best, 1000 * best[1] // best[2] if mine else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def noisy_periods(rnd):
    w = []
    while len(w) < rnd.randrange(0, 120):
        p = [rnd.choice("abc") for _ in range(rnd.randrange(1, 12))]
        if rnd.random() < .5:
            p = p[:1] * rnd.randrange(1, 9) + p  # a short period inside a long one
        w += (p * 7)[:rnd.randrange(1, len(p) * 6 + 1)] if rnd.random() < .5 else p
    return " ".join(w)


def test_runs_equal_brute_force(sql):
    rnd = random.Random(5)
    rows = [(rnd.randrange(50), noisy_periods(rnd), "en") for _ in range(400)] + EDGE
    for batch in (1, 500):  # every text alone, and many texts end to end
        got = periodic.find_runs(docs_of(sql, rows), batch_words=batch).collect()
        want = [plain_row(i, [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if x]) for i, t, _ in rows]
        assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(want, key=key)
        for r in got:
            assert hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"] and len(r["runs"]) == r["n_runs"]
    assert periodic.find_runs(docs_of(sql, [])).count() == 0


def test_planted_query_equals_brute_force(sql):
    docs = sql.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = []
    for d in docs:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (d["text"] or "").encode()) if x]
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want.append(plain_row(d["doc_id"], w))
    got = queries.op11_periodic_runs(sql, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5


def test_wavelet_tree_and_suffix_array():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 3, 300)
    s = periodic.Suffixes(codes)
    assert [tuple(codes[i:]) for i in s.sa] == sorted(tuple(codes[i:]) for i in range(300))
    tree = periodic.WaveletTree(s.sa)
    lo = rnd.integers(0, 200, 500)
    hi = lo + rnd.integers(1, 100, 500)
    x = rnd.integers(0, 700, 500)
    assert tree.below(lo, hi, x).tolist() == [int((s.sa[a:b] < v).sum()) for a, b, v in zip(lo, hi, x)]
    k = (hi - lo) // 2
    assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(s.sa[a:b])[c]) for a, b, c in zip(lo, hi, k)]


# --- set similarity -----------------------------------------------------------------------

def plain_set(t):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode().split()
    return {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def plain_sets(rows):
    sets = [plain_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    ids = [i if i is not None else float("inf") for i, _, _ in rows]
    out = []
    for x, (i, _, _) in enumerate(rows):
        c = min(ids[y] for y in range(len(rows)) if find(y) == find(x)) if sets[x] else ids[x]
        c = None if c == float("inf") else c
        out.append((i, len(sets[x]), c, i == c))
    return sorted(out, key=key)


def near_texts(rnd, n, changes):
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randrange(changes + 1)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10 ** 6)}"
        out.append((rnd.randrange(10 ** 6), " ".join(w), "en"))
    return out


def test_minhash_equals_all_pairs(sql):
    rnd = random.Random(2)
    rows = near_texts(rnd, 60, 6) + near_texts(rnd, 40, 3) + near_texts(rnd, 5, 1) * 3 + EDGE
    # a chain: each text shares enough with the next, the ends share little
    chain = [f"c{i}" for i in range(200)]
    rows += [(2000 + i, " ".join(chain[i * 6:i * 6 + 110]), "en") for i in range(12)]
    got = minhash.near_duplicates(docs_of(sql, rows)).collect()
    want = plain_sets(rows)
    assert sorted(map(tuple, got), key=key) == want
    assert len({r[2] for r in want}) < len(rows)
    got = minhash.near_duplicates(docs_of(sql, rows), block=2).collect()  # cells cut into blocks of about two
    assert sorted(map(tuple, got), key=key) == want
    assert minhash.near_duplicates(docs_of(sql, [])).count() == 0


def test_sketch_is_filled_and_concentrated():
    rnd = np.random.default_rng(3)
    t, errors = 128, []
    for n in (1, 2, 7, 50, 1000):
        for _ in range(20):
            common = rnd.integers(0, 1 << 63, n).astype(np.uint64)
            extra = rnd.integers(0, 1 << 63, max(1, n // 5)).astype(np.uint64)
            h = np.concatenate([common, extra, common])
            doc = np.repeat([0, 1], [len(common) + len(extra), len(common)])
            s = minhash.sketch(doc, h, 3, t)
            assert (s[:2] != np.uint64((1 << 64) - 1)).all() and (s[2] == np.uint64((1 << 64) - 1)).all()
            errors.append((s[0] == s[1]).mean() - n / (n + len(extra)))
    assert abs(np.mean(errors)) < 0.015 and np.abs(errors).max() < 0.2
    assert minhash.least_equal(128, 85) == 77


def test_common_counts_shared_shingles(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 3)
    rnd = random.Random(6)
    sets = [set(rnd.sample(range(-20, 20), rnd.randrange(12))) for _ in range(15)]
    for x, y in ((np.arange(0, 9), np.arange(9, 15)), (np.arange(15), np.arange(15))):
        got = minhash.common([np.array(sorted(s), np.int64).tobytes() for s in sets], x, y)
        assert all(got[i, j] == len(sets[x[i]] & sets[y[j]]) for i in range(len(x)) for j in range(len(y)) if x[i] != y[j])
    assert minhash.common([b"", b""], np.array([0]), np.array([1])).tolist() == [[0]]


# --- phrases ------------------------------------------------------------------------------

def plain_phrases(rows, min_count, top):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in (1, 2, 3, 4):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i:i + m])] += 1
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    inside = {}
    for (lang, w), a in c.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                k = (lang, w[i:i + m])
                inside[k] = max(inside.get(k, 0), a)
    out = []
    for (lang, w), a in c.items():
        if 100 * inside.get((lang, w), 0) >= 80 * a:
            continue
        s, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], k))
    rank, rows_out = Counter(), []
    for lang, s, a, w, left, right, k in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows_out.append((lang, rank[lang], w.decode(), -a, left, right, n[lang], -s, k))
    return rows_out


def test_phrases_equal_brute_force(sql):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        parts = [rnd.choice(["Alpha beta gamma delta", "beta gamma", "x y z. x y", "ring a b c ring a b c ring a b c", "é, ü\té",
                             "a a a a a a", "one two three four five six seven eight nine", "p q\nr", "Q"]) for _ in range(rnd.randrange(9))]
        rows.append((i, rnd.choice([" ", "; ", "\x0b"]).join(parts), rnd.choice(["en", "en", "de", None])))
    rows += EDGE
    for min_count, top in ((3, 2000), (30, 7)):
        got = sorted(map(tuple, phrases.mine(docs_of(sql, rows), min_count, top).collect()))
        assert got == sorted(plain_phrases(rows, min_count, top)) and got
    assert phrases.mine(docs_of(sql, [])).count() == 0


def test_paths_are_compacted_and_rings_cut(sql):
    text = "one two three four five six seven eight nine ten."
    rows = [(i, text + " " + " ".join("r s t u v w".split() * 3) + ". odd one two three four. two three four odd", "en") for i in range(5)]
    frequent, three, *_ = phrases.graph(docs_of(sql, rows), 5)
    got, nodes = phrases.paths(frequent, three)
    words = sorted(" ".join(r["words"]) for r in got.collect())
    assert "two three four five six seven eight nine ten" in words  # from where the two ways split
    ring = [w for w in words if "r s t" in w]
    assert len(ring) == 1 and len(ring[0].split()) == 6 + 3  # six edges, each once
    small, _ = phrases.paths(frequent, three, block=2)
    assert max(len(r["counts"]) for r in small.collect()) == 2
    assert sum(len(r["counts"]) for r in small.collect()) == sum(len(r["counts"]) for r in got.collect()) == frequent.count()
    for r in got.collect():
        assert len(r["words"]) == len(r["counts"]) + 3 == len(r["flows"]) + 2


def test_registered_queries_and_oracles(sql):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name in queries.ORACLES:
        got = queries.QUERIES[name](sql, SMALL)
        want = con.execute(queries.ORACLES[name])
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
