"""Exact linear-interpolated quantiles without holding a group in one task.

For group ``g`` with ``n`` values and probability ``p`` the quantile is
``v[lo] + (h - lo) * (v[hi] - v[lo])`` with ``h = (n - 1) p``, ``lo = floor(h)``,
``hi = ceil(h)`` (0-based ranks ascending; the common "linear" definition).

Order statistics are found by distributed refinement: each round buckets the
values of every unresolved target range into ``buckets`` buckets, equally wide on a
scale of signed powers of two while the range spans more than one (so infinities and
values of any magnitude are told apart at once), and in value after that
(``groupBy`` with partial aggregation, one row per non-empty bucket), locates
the bucket holding the target rank from cumulative counts (a window over at
most ``buckets`` rows per target) and narrows the range to it. A target whose
range holds at most ``max_exact`` values (or one distinct value) is finished by
sorting just those values. Memory per task is bounded by ``buckets`` and
``max_exact``, never by the group size; the driver only loops over rounds and
reads one count per round. The small target table is written to the shared
folder each round. The default ``max_exact`` (2,000,000 values, 16 MB of doubles)
keeps a finishing task small while letting moderate groups finish in one pass.
"""
from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


#: A range with at most so many values is sorted.
MAX_EXACT = 2_000_000


def power(v):
    """Signed place of a double on the scale of powers of two: 0 for 0, 1 for the smallest positive value, 2200 for
    infinity. It never decreases with ``v``."""
    size = F.when(F.abs(v) == float("inf"), 2200.0).otherwise(F.log2(F.abs(v)) + 1075)
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * size)


def exact_quantiles(long: DataFrame, group_cols, probs, value: str = "value",
                    max_exact: int = MAX_EXACT, buckets: int = 16_384, max_rounds: int = 64) -> DataFrame:
    """``(group_cols..., p, q)`` for every group and probability (nulls ignored; infinities are values).

    One round brings a range within a power of two, and four more would tell all doubles in it apart.
    """
    g = list(group_cols)
    data = long.select(*g, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = data.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    stats = materialize(stats, "quantile-stats")   # one row per group
    pr = F.array(*[F.lit(float(p)) for p in probs])
    tg = (stats.select(*g, "n", "mn", "mx", F.explode(pr).alias("p"))
               .withColumn("h", (F.col("n") - 1) * F.col("p"))
               .withColumn("r", F.explode(F.array(F.floor("h").cast("long"), F.ceil("h").cast("long")))))
    # distinct order statistics to find: (g, r) with the whole range
    todo = (tg.select(*g, "r", F.col("mn").alias("lo"), F.col("mx").alias("hi"),
                      F.lit(0).cast("long").alias("off"), F.col("n").alias("cnt")).distinct())
    if todo.where((F.col("cnt") > max_exact) & (F.col("lo") < F.col("hi"))).limit(1).count() > 0:
        # refinement rounds will re-read the values: write the compact (group, v) table once
        data = materialize(data, "quantile-values")
    found = []
    rng = [*g, "lo", "hi", "off"]
    for _ in range(max_rounds):
        done = F.col("lo") == F.col("hi")
        small = (F.col("cnt") <= max_exact) & ~done
        found.append(todo.where(done).select(*g, "r", F.col("lo").alias("val")))
        # targets sharing a range (same group, same bounds) are answered together
        fin = todo.where(small)
        fin_vals = (data.join(fin.select(*rng).distinct(), g)
                        .where(F.col("v").between(F.col("lo"), F.col("hi")))
                        .groupBy(*rng).agg(F.sort_array(F.collect_list("v")).alias("vs"))
                        .join(fin.select(*rng, "r"), rng)
                        .select(*g, "r", F.element_at("vs", (F.col("r") - F.col("off") + 1).cast("int"))
                                .alias("val")))
        found.append(fin_vals)
        big = todo.where(~small & ~done)
        if big.limit(1).count() == 0:
            break
        ranges = big.select(*rng).distinct()
        lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
        wide = power(hi) - power(lo)
        at = F.when(wide > 1, (power(v) - power(lo)) / wide).otherwise((v - lo) / (hi - lo))
        b = F.least(F.lit(buckets - 1), F.floor(at * buckets).cast("int"))
        hist = (data.join(ranges, g).where(F.col("v").between(F.col("lo"), F.col("hi")))
                    .groupBy(*rng, b.alias("b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax")))
        w = Window.partitionBy(*rng).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        hit = F.col("r") >= F.col("off") + F.col("before")
        hit = hit & (F.col("r") < F.col("off") + F.col("before") + F.col("c"))
        todo = materialize(hist.join(big.select(*rng, "r"), rng).where(hit).select(
            *g, "r", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"),
            (F.col("off") + F.col("before")).cast("long").alias("off"), F.col("c").alias("cnt")),
            "quantile-targets")
    else:
        raise RuntimeError(f"quantiles not resolved in {max_rounds} rounds")
    vals = found[0]
    for f in found[1:]:
        vals = vals.unionByName(f)
    vals = materialize(vals, "quantile-values-found")   # one row per target, read twice below
    lo_v = vals.select(*g, F.col("r").alias("r_lo"), F.col("val").alias("v_lo"))
    hi_v = vals.select(*g, F.col("r").alias("r_hi"), F.col("val").alias("v_hi"))
    out = (tg.select(*g, "p", "h").distinct()
             .withColumns({"r_lo": F.floor("h").cast("long"), "r_hi": F.ceil("h").cast("long")})
             .join(lo_v, [*g, "r_lo"]).join(hi_v, [*g, "r_hi"]))
    q = F.when((F.col("h") == F.col("r_lo")) | (F.col("v_lo") == F.col("v_hi")), F.col("v_lo")).otherwise(  # no inf - inf
        F.col("v_lo") + (F.col("h") - F.col("r_lo")) * (F.col("v_hi") - F.col("v_lo")))
    return out.select(*g, "p", q.alias("q"))


def quantile_columns(long: DataFrame, group_cols, probs, names, **kw) -> DataFrame:
    """Pivot :func:`exact_quantiles` to one column per probability."""
    q = exact_quantiles(long, group_cols, probs, **kw)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy(*group_cols).agg(*aggs)
