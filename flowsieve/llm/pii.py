"""Personal data: candidate spans, boosted trees and calibrated thresholds, all in DataFrame functions.

High-recall generators (regular expressions) propose overlapping spans with code-point
offsets: the four base kinds as stated, and a loose one of each kind, e-mail addresses with
spelled-out signs, national phone numbers without a plus, addresses with bracketed or spelled-out
dots, and card numbers grouped by dots, strokes or wide gaps. Base candidates are decided by their
kind's stated test alone. Loose candidates that pass their kind's test of digits are judged by gradient
boosted trees, one model a kind, on small integer features of their form and of the words before and after them.

Training needs no hand labels and shows the trees nothing that a label is made of. Phone: the
national part of a number with a plus is a positive, read as if plus and country code were
not there; the first ten digits of a longer run are a negative. E-mail: an address with real
signs is a positive, of which only name, last label and words count; prose with "at" before
the last word of a sentence is a negative. Address: four numbers with dots are a positive, a negative
if a number is above 255 or the row of numbers goes on. Card: 14 to 19 digits, by the Luhn test.
The labelled candidates of the whole table are counted by feature cell and by half of the table
(texts by hash, so copies share a half): a bounded count whatever the table's size. Thresholds are set
on held-out cells: each half is scored by trees that were fitted to the other, and a kind's
threshold is the smallest score from which these held-out candidates keep the wanted precision
(``calibration`` reports precision and recall there). The trees of both halves together go back into the plan as
CASE expressions. A span is added when it has no label of its own, its score passes and no base
span of its kind already covers it.

No Python runs in tasks, no shuffle but the cell counts. Offsets come from the lengths of the
pieces between matches, summed in chunks, so a text with many matches stays cheap.

Cases: null text is empty text; repeated rows are judged each; a kind without positives or
without negatives in the table, or whose held-out candidates never reach the precision, gets no added spans; an empty table gives an empty result;
other columns are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: A dot that is bracketed or spelled out; a separator of card groups that the base pattern lacks.
_DOT = r"(?:\.| ?(?:[\[({]\.[\])}]|[\[({]dot[\])}]) ?| dot )"
_WIDE = r"(?:[._/\xA0]|[\x20-]{2,3})"
#: Generators: kind, pattern. Possessive loops match the same spans as the stated patterns
#: without recursion on long runs; a start inside a run that its beginning already ruled out is skipped.
GENERATORS = (
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", rf"(?i)(?<!{_LOCAL}){_LOCAL}++(?:(?: ?(?:\(at\)|\[at\]|\{{at\}}) ?| at )[A-Za-z0-9-]++"
              r"(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++\.\s[A-Za-z]++)"),
    ("phone", r"(?<![0-9])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?:[ .-]?[0-9])*+"),
    ("ip", rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?!{_DOT}[0-9]|[0-9])"),
    ("card", rf"(?<![0-9])[0-9]{{4}}{_WIDE}[0-9]{{4,6}}{_WIDE}[0-9]{{4,5}}(?:{_WIDE}[0-9]{{1,7}})?(?!{_WIDE}?[0-9])"),
)
BASE = 4  # the first generators are the base kinds
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words around a candidate, by class; the last that is there counts.
_WORDS = ("order|part|serial|invoice|item|ref|sku|code|case|batch|model|version|isbn|account", r"\bip\b|host|addr",
          "card|visa|credit|master", "mail|contact|write|reach", "tel|phone|call|mobile|fax|dial")
_TLD = r"(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|uk|us|ch|at|be|ca|au|jp|cn|in|br|ru|pl|se)"
_PLUS = r"\+[0-9]{1,3}[ .-]?$"
FEATURES = ("kind", "form", "tail", "before", "after")
CHUNK, ROUNDS, DEPTH, RATE, PRECISION = 256, 12, 3, 0.4, 0.98


def _running(steps: Column) -> Column:
    """Running sums of an array of longs, in chunks: n * CHUNK additions instead of n * n."""
    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(steps, b * CHUNK + 1, F.lit(CHUNK))))
    before = F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))
    return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(
        F.slice(steps, b * CHUNK + 1, F.lit(CHUNK)),
        lambda _, i: s + total(F.slice(steps, b * CHUNK + 1, i + 1)))))


def _luhn(digits: Column) -> Column:
    """Luhn test of a string of at most 19 digits."""
    padded, total = F.lpad(digits, 20, "0"), F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def _passes(gen: int, m: Column) -> Column:
    """The stated test of a candidate of generator ``gen``."""
    kind = GENERATORS[gen][0]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        dotted = m if gen < BASE else F.regexp_replace(m, "[^0-9]+", ".")
        return F.regexp_like(dotted, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone" and gen >= BASE:  # the digits of a longer run are no number of their own
        return n == 10
    return n.between(14, 19) & _luhn(F.when(n <= 19, digits).otherwise("")) if kind == "card" else n.between(10, 15)


def _gate(gen: int, text: Column) -> Column:
    """A cheap condition that a text with a match of the generator meets."""
    if gen == 0:
        return text.contains("@")
    if gen == 3:
        return text.contains("+")
    if gen == 4:
        return F.regexp_like(text, F.lit(r"(?i)[( \[{]at[) \]}]"))
    if gen == 6:
        return F.regexp_like(text, F.lit(r"(?i)[0-9] ?(?:[\[({]\.[\])}]|[\[({ ]dot[\])} ])"))
    if gen == 7:
        return F.regexp_like(text, F.lit(rf"[0-9]{{4}}{_WIDE}[0-9]{{4}}"))
    return F.regexp_like(text, F.lit("[0-9]"))


def candidates(docs: DataFrame) -> DataFrame:
    """``cands``: array of (gen, s, e, features) of every generator, offsets in code points, end exclusive."""
    df = texts(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for g, (_, pattern) in enumerate(GENERATORS):
        gate = _gate(g, F.col("text"))
        df = df.withColumn(f"m{g}", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    for g, (_, pattern) in enumerate(GENERATORS):
        df = df.withColumn(f"p{g}", F.when(F.size(f"m{g}") > 0, F.split("text", pattern, -1)))
    for g in range(len(GENERATORS)):
        m, p = F.col(f"m{g}"), F.col(f"p{g}")
        before = F.concat(F.array(F.lit(0).cast("long")), F.transform(m, lambda x: F.length(x).cast("long")))
        steps = F.zip_with(F.slice(p, F.lit(1), F.size(m)), F.slice(before, F.lit(1), F.size(m)),
                           lambda gap, prev: F.length(gap).cast("long") + prev)
        df = df.withColumn(f"s{g}", F.when(F.size(m) > 0, steps))
    arrays = []
    for g in range(len(GENERATORS)):
        df = df.withColumn(f"a{g}", F.when(F.size(f"m{g}") > 0, _running(F.col(f"s{g}"))))
        df = df.withColumn(f"b{g}", F.slice(f"p{g}", F.lit(1), F.size(f"m{g}")))
        df = df.withColumn(f"n{g}", F.slice(f"p{g}", F.lit(2), F.size(f"m{g}")))
        arrays.append(F.when(F.size(f"m{g}") > 0, F.transform(
            F.arrays_zip(f"m{g}", f"a{g}", f"b{g}", f"n{g}"), _describer(g))))
    empty = F.array().cast("array<struct<gen:int,s:bigint,e:bigint,passes:int,kind:int,form:int,tail:int,before:int,"
                           "after:int,label:int>>")
    return df.select("doc_id", "text", "row", F.concat(*[F.coalesce(a, empty) for a in arrays]).alias("cands"))


def _describer(g: int):
    return lambda c: _described(g, c[f"m{g}"], c[f"a{g}"], c[f"b{g}"], c[f"n{g}"])


def _word(near: Column) -> Column:
    word = F.lit(0)
    for i, pattern in enumerate(_WORDS, 1):
        word = F.when(F.regexp_like(near, F.lit(pattern)), i).otherwise(word)
    return word


def _described(g: int, m: Column, start: Column, gap: Column, following: Column) -> Column:
    kind, none = GENERATORS[g][0], F.lit(None).cast("int")
    form = tail = before = after = F.lit(0)
    label, judged = none, F.lit(True)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":  # nothing of the signs: they tell a labelled candidate from a judged one
        name = F.regexp_extract(m, rf"^{_LOCAL}+", 0)
        form = F.regexp_like(name, F.lit("[0-9]")).cast("int") + 2 * F.regexp_like(name, F.lit("[._%+-]")).cast("int")
        last = F.lower(F.regexp_extract(m, "[A-Za-z0-9-]+$", 0))
        tail = F.when(F.regexp_like(last, F.lit(f"^{_TLD}$")), 0).when(F.length(last) < 4, 1).otherwise(2)
        label = F.lit(1) if g < BASE else F.when(F.regexp_like(m, F.lit(r"\.\s[A-Za-z]+$")), 0)
    elif kind == "ip":
        form = F.least(F.length(digits), F.lit(13))
        tail = F.regexp_like(m, F.lit("^[0-9][^0-9]")).cast("int")
        if g < BASE:
            goes_on = F.regexp_like(gap, F.lit(r"[0-9]\.$")) | F.regexp_like(following, F.lit(r"^\.[0-9]"))
            label = F.when(_passes(g, m) & ~goes_on, 1).otherwise(0)
    elif kind == "card":
        n = F.length(digits)
        judged = n.between(14, 19)
        form = F.when(n == 16, 0).when(n < 16, 1).otherwise(2)
        tail = F.regexp_like(digits, F.lit("^[3-6]")).cast("int")
        if g < BASE:
            label = F.when(judged, _passes(g, m).cast("int"))
    elif g >= BASE:
        head = F.regexp_extract(m, r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", 0)
        form = sum(bit * F.regexp_like(head, F.lit(sign)).cast("int")
                   for bit, sign in ((1, " "), (2, r"\."), (4, "-"), (8, r"[()]")))
        ten = F.length(digits) == 10
        label = F.when(F.regexp_like(gap, F.lit(_PLUS)), F.when(ten, 1)).when(
            ~ten | F.regexp_like(gap, F.lit("[0-9][ .-]?$")), 0)
        gap = F.regexp_replace(F.right(gap, F.lit(32)), _PLUS, "")
    if g >= BASE or kind != "phone":
        before = F.when(judged, _word(F.lower(F.right(gap, F.lit(24))))).otherwise(0)
        after = F.when(judged, _word(F.lower(F.left(following, F.lit(16))))).otherwise(0)
    fields = {"gen": F.lit(g), "s": start, "e": start + F.length(m), "passes": _passes(g, m),
              "kind": F.lit(KINDS.index(kind)), "form": form, "tail": tail, "before": before, "after": after,
              "label": label}
    return F.struct(*[(c if k in "se" else c.cast("int")).alias(k) for k, c in fields.items()])


def _fit_tree(x, grad, hess, depth):
    """Regression tree on integer features: nested ('split', feature, value, left, right) or a leaf value."""
    leaf = float(-grad.sum() / (hess.sum() + 1.0))
    best = (1e-9, None)
    for f in range(x.shape[1]) if depth else ():
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            gain = sum(grad[k].sum() ** 2 / (hess[k].sum() + 1.0) for k in (left, ~left)) \
                - grad.sum() ** 2 / (hess.sum() + 1.0)
            if gain > best[0]:
                best = (gain, (f, int(v), left))
    if best[1] is None:
        return leaf
    f, v, left = best[1]
    return ("split", f, v, _fit_tree(x[left], grad[left], hess[left], depth - 1),
            _fit_tree(x[~left], grad[~left], hess[~left], depth - 1))


def _eval_tree(tree, x):
    if isinstance(tree, float):
        return np.full(len(x), tree)
    _, f, v, left, right = tree
    return np.where(x[:, f] <= v, _eval_tree(left, x), _eval_tree(right, x))


def boost(cells: np.ndarray, positive: np.ndarray, total: np.ndarray) -> list:
    """Logistic gradient boosting on weighted feature cells."""
    trees, score = [], np.zeros(len(cells))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _fit_tree(cells, total * p - positive, total * p * (1 - p), DEPTH)
        trees.append(tree)
        score += RATE * _eval_tree(tree, cells)
    return trees


def _score(trees: list, x: np.ndarray) -> np.ndarray:
    return RATE * sum((_eval_tree(t, x) for t in trees), np.zeros(len(x)))


def _fit(x, pos, n):
    cap = np.minimum(n, 1000.0)  # weights of very full cells level off; their rates stay
    return boost(x, pos / n * cap, cap)


def calibration(cands: DataFrame) -> dict[str, dict]:
    """By kind with both labels: ``trees`` of all cells, ``cut`` and, from there on, ``precision`` and ``recall``
    of the held-out labelled candidates (None where no cut has the wanted precision); ``labelled``: their number."""
    # explode_outer: for explode the optimizer infers a filter that computes all candidates once more, slowly
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    rows = (cands.select(half, F.explode_outer("cands").alias("c")).where("c.label is not null")
            .groupBy("half", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
            .agg(F.sum("c.label").alias("pos"), F.count("*").alias("n")).collect())
    out = {}
    for i, kind in enumerate(KINDS):
        mine = sorted((r for r in rows if r["kind"] == i), key=lambda r: (r["half"], *[r[f] for f in FEATURES]))
        if not 0 < sum(r["pos"] for r in mine) < sum(r["n"] for r in mine):
            continue
        x = np.array([[r[f] for f in FEATURES] for r in mine])
        pos, n = np.array([float(r["pos"]) for r in mine]), np.array([float(r["n"]) for r in mine])
        fold, held = np.array([r["half"] for r in mine]), np.zeros(len(mine))
        for f in (0, 1):
            other = fold != f
            held[~other] = _score(_fit(x[other], pos[other], n[other]), x[~other])
        order = np.argsort(-held, kind="stable")
        score, good, seen = held[order], np.cumsum(pos[order]), np.cumsum(n[order])
        whole = np.r_[np.diff(score) < -1e-9, True]  # equal scores pass or fail together
        fine = np.flatnonzero((good >= PRECISION * seen) & whole)
        at = fine[-1] if len(fine) else None
        out[kind] = {"trees": _fit(x, pos, n), "labelled": int(n.sum()),
                     "cut": None if at is None else float(score[at]) - 1e-9,
                     "precision": None if at is None else float(good[at] / seen[at]),
                     "recall": None if at is None else float(good[at] / pos.sum())}
    return out


def train(cands: DataFrame) -> dict[str, tuple[list, float]] | None:
    """Trees and threshold of each kind that can have added spans."""
    got = {k: (c["trees"], c["cut"]) for k, c in calibration(cands).items() if c["cut"] is not None}
    return got or None


def _tree_column(tree, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    _, f, v, left, right = tree
    return F.when(c[FEATURES[f]] <= v, _tree_column(left, c)).otherwise(_tree_column(right, c))


def spans(cands: DataFrame, model) -> DataFrame:
    """``base`` and ``spans``: arrays of (s, k, e) by start and kind (k indexes KINDS)."""
    kind = {g: KINDS.index(k) for g, (k, _) in enumerate(GENERATORS)}

    def short(c):
        k = F.lit(kind[0])
        for g in range(1, len(GENERATORS)):
            k = F.when(c["gen"] == g, kind[g]).otherwise(k)
        return F.struct(c["s"].alias("s"), k.alias("k"), c["e"].alias("e"))
    base = F.array_sort(F.transform(F.filter("cands", lambda c: (c["gen"] < BASE) & (c["passes"] == 1)), short))
    out = cands.withColumn("base", base)
    if model is None:
        return out.withColumn("spans", F.col("base"))

    def chosen(c):
        passed = F.lit(False)
        for k, (trees, cut) in model.items():
            score = F.lit(0.0)
            for t in trees:
                score = score + RATE * _tree_column(t, c)
            passed = F.when(c["kind"] == KINDS.index(k), score >= cut).otherwise(passed)
        return passed
    out = out.withColumn("more", F.transform(F.filter("cands", lambda c: (c["gen"] >= BASE) & c["label"].isNull() & (
        c["passes"] == 1) & chosen(c)), short))
    fresh = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["s"] <= m["s"]) & (m["e"] <= b["e"])
                                                 & (b["k"] == m["k"])))
    return out.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.array_union("base", fresh)))
                          .otherwise(F.col("base")))


def _of_kind(i: int):
    return lambda s: s["k"] == i


def _joined(col: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(col, lambda s: F.concat_ws(
        ":", names[s["k"]], s["s"].cast("string"), s["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, counts and digest of base spans, ``spans_text`` and the array ``spans``, per row."""
    cands = candidates(docs)
    got = spans(cands, train(cands))
    return got.select(
        "doc_id", "text", "spans",
        *[F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans_text"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its spans replaced by their kind in brackets; all other columns as they are.

    Overlapping spans are replaced together, under the name of the first.
    """
    cands = candidates(docs)
    got = spans(cands, train(cands))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["s"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"),
                        F.when(s["s"] >= acc["at"], F.concat(acc["parts"], F.array(gap, names[s["k"]])))
                        .otherwise(acc["parts"]).alias("parts"))
    walked = F.when(F.size("spans") > 0, F.aggregate("spans", start, step))
    got = got.withColumn("w", walked)
    text = F.when(F.col("w").isNull(), F.col("row.text")).otherwise(F.concat(
        F.array_join("w.parts", ""), F.substring(F.col("text"), (F.col("w.at") + 1).cast("int"), F.length("text"))))
    return got.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
