"""License scans by patience alignment of a text with license templates.

Words unique to both sides are the anchors; their longest increasing subsequence fixes the
alignment and the gaps between anchors are aligned in the same way, after equal words at
both ends of a gap are taken. Coverage is the share of template words aligned. Agreement also
counts what the text puts between them: aligned words over template words plus inserted words.
It is 0 where a word that decides between licenses (``DECIDING``: Lesser, Affero, NC, ND, SA, not, the
numbers of a template) is in one side's alignment alone, or a negation stands just before it.
A template is found at an agreement of ``COVERAGE`` or more; of templates found in one place
the longest counts that holds the others. A text can hold a notice anywhere and more than once. A
notice that may lack m words of its template has at least one of any m + 1 of them, so each
template is aligned in the regions around every occurrence of its m + 1 rarest word positions
(a word that the text lacks is the rarest and has no region), at every start that a region
with an aligned seed can have, so the result is that of aligning every region of the text;
a text that lacks too many of a template's words to reach the coverage is not aligned at all.

Templates are notice lines, file headers and whole short texts, in ``license_texts.py``; another list is a parameter.

Cases: null or empty text has no license; repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from .common import annotate
from .license_texts import TEMPLATES

COVERAGE = 0.9
_WORD = re.compile(r"\w+")
#: Words that tell licenses with similar texts apart, and negations.
NEGATIONS = frozenset("not never isn aren neither".split())
DECIDING = NEGATIONS | frozenset("lesser library affero documentation nc nd sa noncommercial noderivatives noderivs sharealike".split())


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the words of ``a`` and ``b`` aligned with each other (in order, each once)."""
    got, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            got.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            got.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at = {w: i for i, w in enumerate(a[alo:ahi], alo) if na[w] == 1}
        pairs = [(at[w], j) for j, w in enumerate(b[blo:bhi], blo) if nb[w] == 1 and w in at]
        if not pairs:
            continue
        tails, ends, back = [], [], [-1] * len(pairs)  # longest increasing subsequence of text positions
        for k, (i, _) in enumerate(pairs):
            p = bisect_left(tails, i)
            back[k] = ends[p - 1] if p else -1
            tails[p:p + 1], ends[p:p + 1] = [i], [k]
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        got += chain
        i0, j0 = alo, blo
        for i, j in [*reversed(chain), (ahi, bhi)]:
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(got)


def patience(a: list, b: list) -> int:
    """Number of words of ``b`` aligned with ``a``."""
    return len(align(a, b))


def coverage(ws: list, start: int, end: int, t: list) -> float:
    """Share of the template's words aligned with a region of the text."""
    return patience(ws[start:end], t) / len(t)


def agreement(ws: list, start: int, end: int, t: list) -> float:
    """Aligned words over template words and words inserted between them; 0 where deciding words differ.

    Up to as many words as a notice may lack are left off the ends of the alignment, where that agrees better.
    """
    pairs, n, best = [(start + i, j) for i, j in align(ws[start:end], t)], len(t), 0.0
    spare = sum(1 for k in range(n) if k / n >= COVERAGE)
    must = {j for j, w in enumerate(t) if w in DECIDING or w.isdigit()}
    if n - len(pairs) > spare or not must <= {j for _, j in pairs}:
        return 0.0
    for cut in range(n - len(pairs), spare + 1):  # words of the template without a partner
        drop = cut - (n - len(pairs))
        for k in range(drop + 1):
            kept = pairs[k:len(pairs) - (drop - k)]
            lo, hi = kept[0][0], kept[-1][0] + 1
            share = len(kept) / (n + hi - lo - len(kept))
            if share > best:
                mine = {i for i, _ in kept}
                if must <= {j for _, j in kept} and not NEGATIONS.intersection(ws[max(0, lo - 2):lo]) and \
                        not any(ws[i] in DECIDING for i in range(lo, hi) if i not in mine):
                    best = share
    return best


def scan(text: str, templates: list, measure=coverage) -> list[tuple[str, float]]:
    """(license, coverage) of the templates found in a whole text; best coverage for each license.

    Where templates match in the same place, one that holds the others counts, then the best coverage there, then the longest.
    ``measure`` is ``coverage`` or ``agreement``, which is never above it.
    """
    ws = _WORD.findall(text.lower())
    have, found, places = set(ws), [], None
    for name, t, vocab in templates:
        if sum(1 for w in t if w in have) < COVERAGE * len(t):
            continue
        if places is None:
            places = {}
            for i, w in enumerate(ws):
                places.setdefault(w, []).append(i)
        n, bag, hits = len(t), Counter(t), []
        spare = sum(1 for k in range(n) if k / n >= COVERAGE)  # words a notice may lack
        seeds = sorted(range(n), key=lambda j: (len(places.get(t[j], ())), t[j], j))[:spare + 1]
        slack, known = max(2, n // 4), {}
        reach = slack + spare  # a region with an aligned seed starts no farther from the seed's own start
        for start in sorted({p - j for j in seeds for p in places.get(t[j], ())}):
            around = Counter(w for w in ws[max(0, start - reach - slack):start + n + reach + slack] if w in bag)
            if (around & bag).total() < n - spare:
                continue
            share = 0.0
            for lo in sorted(range(start - reach, start + reach + 1), key=lambda x: abs(x - start)):
                if lo not in known:
                    known[lo] = measure(ws, max(0, lo - slack), max(0, lo + n + slack), t)
                share = max(share, known[lo])
                if share == 1.0:
                    break
            if share >= COVERAGE:
                hits.append((start, share, sum(map(str.__eq__, ws[max(0, start):start + n], t[max(0, -start):]))))
        for k, (start, share, same) in enumerate(hits):  # of hits on one notice, the one that lies best
            if not any(h[1:] > (share, same) for h in hits[max(0, k - 2 * reach):k + 2 * reach + 1]
                       if abs(h[0] - start) <= reach):
                found.append((start, start + n, share, name))
    best, found = {}, sorted(found)
    starts, longest = [f[0] for f in found], max((f[1] - f[0] for f in found), default=0)
    for s, e, share, name in found:
        near = [f for f in found[bisect_right(starts, s - longest):bisect_left(starts, e)] if s < f[1]]
        held = any(f[0] <= (s + e) // 2 < f[1] for f in near if f[1] - f[0] > e - s)
        rest = [f for f in near if not (s <= (f[0] + f[1]) // 2 < e and f[1] - f[0] < e - s)]
        if not held and (share, e - s) >= max((f[2], f[1] - f[0]) for f in rest):
            best[name] = max(best.get(name, 0.0), share)
    return sorted(best.items())


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_licenses, licenses, best_license, best_coverage) per row, judged by agreement."""
    made = [(n, w, sorted(set(w))) for n, w in ((n, _WORD.findall(t.lower())) for n, t in templates) if w]

    def make():
        def f(_, text):
            got = [scan(t, made, agreement) for t in text]
            top = [max(g, key=lambda x: (x[1], x[0])) if g else (None, 0.0) for g in got]
            return [[len(g) for g in got], [",".join(n for n, _ in g) for g in got],
                    _strings(t[0] for t in top), [float(t[1]) for t in top]]
        return f
    return annotate(docs, make, "n_licenses long, licenses string, best_license string, best_coverage double")


def _strings(values):
    import pyarrow as pa
    return pa.array(list(values), pa.string())
