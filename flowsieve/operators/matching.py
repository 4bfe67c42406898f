"""Flow <-> label matching by five-tuple key and time tolerance.

Semantics (per flow):

* A flow's *forward* candidates are labels with ``label.flow_key = flow.flow_key``;
  its *reverse* candidates are labels with ``label.flow_key = flow.flow_key_rev``.
  A candidate counts only when ``|flow.ts - label.ts| <= tolerance``.
* ``cardinality="split"``: a key seen once among flows is matched only against
  label keys seen once, a repeated flow key only against repeated label keys.
  Label rows with a null time still count as occurrences of their key.
  ``cardinality="any"`` lifts the split.
* A flow gets the label of its forward candidates when they all agree (null
  labels ignored); otherwise the reverse candidates are tried the same way.

Plan of :func:`match_flows` (no candidate pairs are ever materialised): label rows and one probe per flow and
direction are shuffled once by key, and running windows find the nearest labels and the nearest contradiction
(``_answer_keys``). Keys of more than ``hot_rows`` rows are found by two counts and take the plan by time cells, which
:func:`match_points` (with its counts of candidates) uses for all keys, so one hot key cannot blow up:

1. key multiplicities by ``groupBy(key).count()`` joined back (map-side partial
   aggregation; AQE broadcasts the count table when it is small at runtime, and
   splits hot keys with skew-join otherwise);
2. labels pre-aggregated to *points* ``(key, ts) -> min/max/count(label)``; flows
   reduced to distinct query points ``(flow_key, ts)``;
3. the window ``[t - tol, t + tol]`` is cut at multiples of ``tol`` into a suffix of
   one time cell, one whole cell and a prefix of the next cell. Label points and
   probes are shuffled once by ``(key, cell)``; running min/max/count windows
   (ascending, descending, whole partition) answer all probes in one sort pass
   each. A partition holds at most one row per distinct timestamp in a cell, so
   its size is bounded by the tolerance, not by the data volume. Tolerances
   wider than ``sub_cell_ms`` (1 h) cut each cell into sub-cells: rows are
   windowed per sub-cell (bounded by ``sub_cell_ms``), whole sub-cells come from
   per-sub-cell summaries windowed per cell against distinct probe coordinates
   (not one probe per flow), and the answers are joined back by coordinate;
4. the probes are recombined per query point, the class rule and unanimity
   rule applied, and the result joined back to the flows on ``(flow_key, ts)``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import with_flow_keys
from ..session import materialize

# Named time tolerances in milliseconds (the pipeline uses "1min").
TIME_TOLERANCES = {
    "10s": 10_000,
    "30s": 30_000,
    "1min": 60_000,
    "2min": 120_000,
    "3min": 180_000,
    "5min": 300_000,
}

FLOW_TS = "bidirectional_first_seen_ms"
UNIQUE, REPEATED = 1, 2
#: A key with more rows than this, labels and probes together, is answered by time cells.
HOT_ROWS = 100_000
#: Keys are counted in this many hash buckets first; only those of too full buckets are counted one by one.
COUNT_BUCKETS = 1 << 17


def numeric_ts(df: DataFrame, col: str) -> Column:
    """Time column as a number; text that is not a number becomes null (C14)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(col).cast("bigint")
    if isinstance(dtype, T.NumericType):
        return F.col(col).cast("double")
    return F.expr(f"try_cast(`{col}` AS DOUBLE)")


def key_counts(df: DataFrame, key: str = "flow_key", name: str = "n") -> DataFrame:
    """``key -> occurrences`` with map-side partial aggregation (J1 building block)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def split_by_key_count(df: DataFrame, key: str = "flow_key") -> DataFrame:
    """Tag each row with how often its key occurs and whether it is unique.

    Rows with a null key get a null count. The count table is joined back on the
    key instead of a window over the key, and written first: a join whose counts come straight
    from their aggregation has no exchange on that side, and AQE can't split a hot key in it.
    """
    counts = materialize(key_counts(df, key, "key_count"), "key-counts")
    return (df.join(counts, on=key, how="left")
              .withColumn("key_class", F.when(F.col("key_count") == 1, F.lit("unique"))
                                        .when(F.col("key_count") > 1, F.lit("repeated"))))


def _prepare(flows: DataFrame, labels: DataFrame, flow_ts: str, label_ts: str):
    if "flow_key" not in flows.columns:
        flows = with_flow_keys(flows)
    if "flow_key" not in labels.columns:
        labels = with_flow_keys(labels)
    if "flow_key_rev" not in flows.columns:
        flows = flows.withColumn("flow_key_rev", F.lit(None).cast("string"))
    f_ts = numeric_ts(flows, flow_ts)
    l_ts = numeric_ts(labels, label_ts)
    integral = (isinstance(flows.select(f_ts).schema[0].dataType, T.LongType)
                and isinstance(labels.select(l_ts).schema[0].dataType, T.LongType))
    if not integral:
        f_ts, l_ts = f_ts.cast("double"), l_ts.cast("double")
    return flows, labels, f_ts, l_ts, integral


def _scoped(c: str, scope) -> Column:
    return F.concat(*[x for s in scope for x in (F.col(s).cast("string"), F.lit("\u001f"))], F.col(c))


def _answer_one_level(q: DataFrame, points: DataFrame, tols, integral: bool) -> DataFrame:
    """Cells of width tol; one shuffle by (tol, key, cell) and three window frames."""
    # --- one (tid, tol) per requested tolerance: all are answered by one shuffle -----
    tol_arr = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(ms).cast("bigint").alias("tol"))
                        for i, (_, ms) in enumerate(tols)])
    width = F.greatest(F.col("tol"), F.lit(1))

    def cell_of(c):
        if integral:
            return F.call_function("div", c - F.pmod(c, width), width)
        return F.floor(c / width).cast("double")

    t_type = q.schema["t"].dataType
    cell_type = "bigint" if integral else "double"

    def part(kind, cell, pos):
        return F.struct(F.lit(kind).alias("kind"), cell.cast(cell_type).alias("cell"),
                        pos.cast(t_type).alias("pos"))

    t, tl = F.col("t"), F.col("tol")
    c0 = cell_of(t - tl)
    parts = F.when(tl == 0, F.array(part("W", t, t))).otherwise(
        F.array(part("S", c0, t - tl), part("W", c0 + 1, t), part("P", c0 + 2, t + tl)))
    probes = (q.select("*", F.explode(tol_arr).alias("tt")).select("*", "tt.tid", "tt.tol")
               .select("qkey", "t", "cls_f", "dir", "jkey", "tid", F.explode(parts).alias("p")))
    null_str, null_long, null_int = (F.lit(None).cast("string"), F.lit(None).cast("bigint"),
                                     F.lit(None).cast("int"))
    probe_rows = probes.select(
        "tid", "jkey", "p.cell", "p.pos", "p.kind", "qkey", "t", "cls_f", "dir",
        null_str.alias("l_min"), null_str.alias("l_max"), null_long.alias("n_lab"),
        null_long.alias("n_cand"), null_int.alias("cls_l"))
    pts = points.select("*", F.explode(tol_arr).alias("tt")).select("*", "tt.tid", "tt.tol")
    point_rows = pts.select(
        "tid", "jkey",
        F.when(F.col("tol") == 0, F.col("ts")).otherwise(cell_of(F.col("ts"))).cast(cell_type).alias("cell"),
        F.col("ts").alias("pos"), F.lit("L").alias("kind"),
        null_str.alias("qkey"), F.col("ts").alias("t"), null_int.alias("cls_f"),
        null_str.alias("dir"), "l_min", "l_max", "n_lab", "n_cand", "cls_l")
    rows = point_rows.unionByName(probe_rows)

    part_w = Window.partitionBy("tid", "jkey", "cell")
    frames = {
        "P": part_w.orderBy(F.col("pos").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow),
        "S": part_w.orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow),
        "W": part_w,
    }
    if all(ms == 0 for _, ms in tols):
        frames = {"W": part_w}

    def pick(agg, col):
        expr = None
        for kind, w in frames.items():
            v = agg(col).over(w)
            expr = F.when(F.col("kind") == kind, v) if expr is None else expr.when(F.col("kind") == kind, v)
        return expr

    answered = (rows.select(
        "kind", "qkey", "t", "tid", "cls_f", "dir",
        pick(F.min, "l_min").alias("l_min"), pick(F.max, "l_max").alias("l_max"),
        pick(F.sum, "n_lab").alias("n_lab"), pick(F.sum, "n_cand").alias("n_cand"),
        pick(F.max, "cls_l").alias("cls_l"))
        .where(F.col("kind") != "L"))
    return answered


def _answer_two_level(q: DataFrame, points: DataFrame, tols, integral: bool, sub_cell_ms: int) -> DataFrame:
    """Cells of width tol cut into sub-cells; rows windowed per sub-cell, sub-cells summarised."""
    # --- one (tid, tol, g) per requested tolerance; all are answered together ---------
    # Time is cut into cells of width tol and each cell into sub-cells of width
    # g = min(tol, SUB_CELL_MS). [t - tol, t + tol] = suffix of a sub-cell (rows)
    # + later sub-cells of that cell (summaries) + one whole cell (summary)
    # + earlier sub-cells of the last cell (summaries) + prefix of a sub-cell (rows).
    tol_arr = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(ms).cast("bigint").alias("tol"),
                                 F.lit(max(1, min(ms, sub_cell_ms))).cast("bigint").alias("g"))
                        for i, (_, ms) in enumerate(tols)])
    t_type = q.schema["t"].dataType
    cell_type = "bigint" if integral else "double"

    def fdiv(c, w):
        if integral:
            return F.call_function("div", c - F.pmod(c, w), w)
        return F.floor(c / w).cast("double")

    tl, g = F.col("tol"), F.col("g")
    tw = F.greatest(tl, F.lit(1))
    zero = tl == 0
    null_str, null_long, null_int = (F.lit(None).cast("string"), F.lit(None).cast("bigint"),
                                     F.lit(None).cast("int"))
    agg_cols = ["l_min", "l_max", "n_lab", "n_cand", "cls_l"]

    # label points per tolerance, with cell and sub-cell
    px = (points.select("*", F.explode(tol_arr).alias("tt")).select("*", "tt.tid", "tt.tol", "tt.g")
                .withColumn("cell", F.when(zero, F.col("ts")).otherwise(fdiv(F.col("ts"), tw)).cast(cell_type)))
    px = px.withColumn("sub", F.when(zero, F.lit(0)).otherwise(
        fdiv(F.col("ts") - F.col("cell") * tl, g)).cast(cell_type))

    # query points per tolerance: the five parts' coordinates
    qx = q.select("*", F.explode(tol_arr).alias("tt")).select("*", "tt.tid", "tt.tol", "tt.g")
    lo, hi = F.col("t") - tl, F.col("t") + tl
    c0 = fdiv(lo, tw).cast(cell_type)
    qx = (qx.withColumn("c0", F.when(zero, F.col("t")).otherwise(c0).cast(cell_type))
            .withColumn("s_lo", fdiv(lo - F.col("c0") * tl, g).cast(cell_type))
            .withColumn("s_hi", fdiv(hi - (F.col("c0") + 2) * tl, g).cast(cell_type)))

    # (1) rows: suffix / prefix inside one sub-cell; windows per (tol, key, cell, sub)
    def coord(kind, cell, sub, pos):
        return F.struct(F.lit(kind).alias("kind"), cell.cast(cell_type).alias("cell"),
                        sub.cast(cell_type).alias("sub"), pos.cast(t_type).alias("pos"))

    row_probes = (qx.where(~zero)
                    .select("qkey", "t", "tid", "cls_f", "dir", "jkey",
                            F.explode(F.array(coord("S", F.col("c0"), F.col("s_lo"), lo),
                                              coord("P", F.col("c0") + 2, F.col("s_hi"), hi))).alias("p"))
                    .select("tid", "jkey", "p.cell", "p.sub", "p.pos", "p.kind", "qkey", "t", "cls_f", "dir",
                            *[(null_str if c in ("l_min", "l_max") else null_int if c == "cls_l" else null_long)
                              .alias(c) for c in agg_cols]))
    row_pts = px.where(~zero).select("tid", "jkey", "cell", "sub", F.col("ts").alias("pos"),
                                     F.lit("L").alias("kind"), null_str.alias("qkey"),
                                     F.col("ts").cast(t_type).alias("t"), null_int.alias("cls_f"),
                                     null_str.alias("dir"), *agg_cols)
    wr = Window.partitionBy("tid", "jkey", "cell", "sub")
    up = wr.orderBy(F.col("pos").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = wr.orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def run(agg, col):
        return F.when(F.col("kind") == "P", agg(col).over(up)).when(F.col("kind") == "S", agg(col).over(down))

    def five(fn):
        return [fn(F.min, "l_min").alias("l_min"), fn(F.max, "l_max").alias("l_max"),
                fn(F.sum, "n_lab").alias("n_lab"), fn(F.sum, "n_cand").alias("n_cand"),
                fn(F.max, "cls_l").alias("cls_l")]

    row_ans = (row_pts.unionByName(row_probes)
               .select("kind", "qkey", "t", "tid", "cls_f", "dir", *five(run))
               .where(F.col("kind") != "L").drop("kind"))

    # (2) sub-cell summaries; targets (one per distinct coordinate, not per flow)
    lsub = px.groupBy("tid", "jkey", "cell", "sub").agg(
        F.min("l_min").alias("l_min"), F.max("l_max").alias("l_max"), F.sum("n_lab").alias("n_lab"),
        F.sum("n_cand").alias("n_cand"), F.max("cls_l").alias("cls_l"))
    want = qx.select("qkey", "t", "tid", "cls_f", "dir", "jkey", F.explode(F.array(
        F.when(~zero, F.struct(F.lit("S").alias("kind"), F.col("c0").alias("cell"), F.col("s_lo").alias("sub"))),
        F.struct(F.lit("W").alias("kind"), F.when(zero, F.col("c0")).otherwise(F.col("c0") + 1)
                 .cast(cell_type).alias("cell"), F.lit(-1).cast(cell_type).alias("sub")),
        F.when(~zero, F.struct(F.lit("P").alias("kind"), (F.col("c0") + 2).cast(cell_type).alias("cell"),
                               F.col("s_hi").alias("sub"))))).alias("w"))
    want = want.where(F.col("w").isNotNull()).select("qkey", "t", "tid", "cls_f", "dir", "jkey",
                                                     "w.kind", "w.cell", "w.sub")
    targets = want.select("tid", "jkey", "cell", "sub", "kind").distinct()
    srows = (lsub.withColumn("kind", F.lit("L")).withColumn("ord", F.lit(1))
             .unionByName(targets.select("tid", "jkey", "cell", "sub", "kind", F.lit(0).alias("ord"),
                                         *[(null_str if c in ("l_min", "l_max") else null_int if c == "cls_l"
                                            else null_long).alias(c) for c in agg_cols])))
    ws = Window.partitionBy("tid", "jkey", "cell")
    after = ws.orderBy(F.col("sub").desc(), F.col("ord").asc()).rowsBetween(Window.unboundedPreceding, 0)
    before = ws.orderBy(F.col("sub").asc(), F.col("ord").asc()).rowsBetween(Window.unboundedPreceding, 0)

    def summ(agg, col):
        return (F.when(F.col("kind") == "S", agg(col).over(after))
                 .when(F.col("kind") == "P", agg(col).over(before))
                 .when(F.col("kind") == "W", agg(col).over(ws)))

    sum_ans = (srows.select("tid", "jkey", "cell", "sub", "kind", *five(summ))
                    .where(F.col("kind") != "L"))
    # answers go back to flow points by the full coordinate (the whole cell uses sub -1)
    sum_part = (want.join(sum_ans, ["tid", "jkey", "cell", "sub", "kind"], "left")
                    .select("qkey", "t", "tid", "cls_f", "dir", *agg_cols))
    answered = row_ans.unionByName(sum_part)
    return answered


def _scope_keys(df: DataFrame, scope) -> DataFrame:
    """Qualify keys by scope columns (e.g. scenario) so each scope is matched alone."""
    q = lambda c: _scoped(c, scope)
    out = {"flow_key": q("flow_key")}
    if "flow_key_rev" in df.columns:
        out["flow_key_rev"] = q("flow_key_rev")
    return df.withColumns(out)


def _match_inputs(flows: DataFrame, labels: DataFrame, directions: str, flow_ts: str, label_ts: str, scope, reuse_points):
    """Probes (qkey, t, cls_f, c, dir, jkey), label points (jkey, ts, l_min, l_max, n_lab, n_cand, cls_l), integral times?"""
    flows, labels, f_ts, l_ts, integral = _prepare(flows, labels, flow_ts, label_ts)
    reuse_points = reuse_points is not False  # the same plan at every size
    if scope:
        flows, labels = _scope_keys(flows, scope), _scope_keys(labels, scope)

    # --- flows: valid rows -> distinct query points (with their row count) ----------
    # The key multiplicity is summed from the points. Points of both sides are
    # written once to the shared folder (``materialize``): every later branch of the
    # plan reads these narrow tables instead of re-scanning and re-aggregating the
    # inputs (Catalyst prunes each branch differently, so exchanges are not reused).
    fpts = (flows.select("flow_key", "flow_key_rev", f_ts.alias("ts"))
                 .where(F.col("flow_key").isNotNull() & F.col("ts").isNotNull())
                 .groupBy("flow_key", "flow_key_rev", "ts").agg(F.count(F.lit(1)).alias("c")))
    # written, so that both join sides are plain exchanges and AQE can split a hot key
    n_f = materialize(fpts.groupBy("flow_key").agg(F.sum("c").alias("n_f")), "match-flow-counts")
    fq = (fpts.join(n_f, "flow_key")
              .withColumn("cls_f", F.when(F.col("n_f") > 1, REPEATED).otherwise(UNIQUE))
              .drop("n_f"))
    if reuse_points:
        fq = materialize(fq, "match-flow-points")

    # --- labels: points (key, ts) incl. a null-time point per key, which counts as an
    # occurrence of the key but never matches -------------------------------------------
    lp = (labels.select("flow_key", l_ts.alias("ts"), F.col("label").cast("string").alias("label"))
                .where(F.col("flow_key").isNotNull())
                .groupBy("flow_key", "ts")
                .agg(F.min("label").alias("l_min"), F.max("label").alias("l_max"),
                     F.count("label").alias("n_lab"), F.count(F.lit(1)).alias("n_cand")))
    n_l = materialize(lp.groupBy("flow_key").agg(F.sum("n_cand").alias("n_l")), "match-label-counts")
    points = (lp.where(F.col("ts").isNotNull())
                .join(n_l, "flow_key")
                .select(F.col("flow_key").alias("jkey"), "ts", "l_min", "l_max", "n_lab", "n_cand",
                        F.when(F.col("n_l") > 1, REPEATED).otherwise(UNIQUE).alias("cls_l")))
    if reuse_points:
        points = materialize(points, "match-label-points")

    # --- probes: one per direction and cell part ------------------------------------
    dirs = [F.struct(F.lit("F").alias("dir"), F.col("flow_key").alias("jkey"))]
    if directions == "both":
        dirs.append(F.when(F.col("flow_key_rev").isNotNull()
                           & (F.col("flow_key_rev") != F.col("flow_key")),
                           F.struct(F.lit("R").alias("dir"), F.col("flow_key_rev").alias("jkey"))))
    q = (fq.select(F.col("flow_key").alias("qkey"), F.col("ts").alias("t"), "cls_f", "c",
                   F.explode(F.array(*dirs)).alias("d"))
           .where(F.col("d").isNotNull())
           .select("qkey", "t", "cls_f", "c", "d.dir", "d.jkey"))
    return q, points, integral


def match_points(flows: DataFrame, labels: DataFrame, tolerance_ms,
                 *, cardinality: str = "split", directions: str = "both",
                 flow_ts: str = FLOW_TS, label_ts: str = "ts_ms", scope=(),
                 sub_cell_ms: int = 3_600_000, reuse_points: bool | None = None) -> DataFrame:
    """Label per distinct flow point ``(flow_key, ts)``.

    ``tolerance_ms`` is one tolerance, or a ``{name: ms}`` dict answered in the
    same shuffle (then ``tolerance`` and ``tolerance_ms`` columns are added).

    Returns ``flow_key, ts, label, match_pass, n_cand_f, n_cand_r`` where
    ``match_pass`` is ``uf``/``ur``/``df``/``dr`` (unique or repeated flow key,
    forward or reverse) and the ``n_cand_*`` columns count class-compatible label
    rows in tolerance (so "has candidates but no label" is observable).
    """
    if cardinality not in ("split", "any"):
        raise ValueError("cardinality must be 'split' or 'any'")
    if directions not in ("both", "forward"):
        raise ValueError("directions must be 'both' or 'forward'")
    multi = dict(tolerance_ms) if isinstance(tolerance_ms, dict) else None
    tols = list(multi.items()) if multi is not None else [(None, tolerance_ms)]
    tols = [(n, int(ms)) for n, ms in tols]
    if not tols or any(ms < 0 for _, ms in tols):
        raise ValueError("tolerances must be >= 0")
    q, points, integral = _match_inputs(flows, labels, directions, flow_ts, label_ts, scope, reuse_points)

    if max(ms for _, ms in tols) <= sub_cell_ms:
        # a cell of width tol <= sub_cell_ms already bounds every window partition
        answered = _answer_one_level(q, points, tols, integral)
    else:
        answered = _answer_two_level(q, points, tols, integral, sub_cell_ms)

    def by_dir(agg, col, d):
        return agg(F.when(F.col("dir") == d, F.col(col)))

    per_point = answered.groupBy("qkey", "t", "tid").agg(
        F.max("cls_f").alias("cls_f"),
        *[e for d in ("F", "R") for e in (
            by_dir(F.min, "l_min", d).alias(f"mn_{d}"), by_dir(F.max, "l_max", d).alias(f"mx_{d}"),
            F.coalesce(by_dir(F.sum, "n_lab", d), F.lit(0)).alias(f"nl_{d}"),
            F.coalesce(by_dir(F.sum, "n_cand", d), F.lit(0)).alias(f"nc_{d}"),
            by_dir(F.max, "cls_l", d).alias(f"cl_{d}"))])

    def same_class(d):
        if cardinality == "any":
            return F.lit(True)
        return F.col(f"cl_{d}") == F.col("cls_f")

    def ok(d):
        return same_class(d) & (F.col(f"nl_{d}") > 0) & (F.col(f"mn_{d}") == F.col(f"mx_{d}"))

    prefix = F.when(F.col("cls_f") == UNIQUE, F.lit("u")).otherwise(F.lit("d"))
    named = multi is not None
    tol_cols = ([F.element_at(F.array(*[F.lit(n) for n, _ in tols]), F.col("tid") + 1).alias("tolerance"),
                 F.element_at(F.array(*[F.lit(ms).cast("bigint") for _, ms in tols]), F.col("tid") + 1)
                  .alias("tolerance_ms")] if named else [])
    return per_point.select(
        F.col("qkey").alias("flow_key"), F.col("t").alias("ts"), *tol_cols,
        F.when(ok("F"), F.col("mn_F")).when(ok("R"), F.col("mn_R")).alias("label"),
        F.when(ok("F"), F.concat(prefix, F.lit("f")))
         .when(ok("R"), F.concat(prefix, F.lit("r"))).alias("match_pass"),
        F.when(same_class("F"), F.col("nc_F")).otherwise(F.lit(0)).cast("bigint").alias("n_cand_f"),
        F.when(same_class("R"), F.col("nc_R")).otherwise(F.lit(0)).cast("bigint").alias("n_cand_r"))


def _side(rows: DataFrame, name: str, order: list, sign: int, keys=("jkey", "cell"), cand: Column | None = None) -> DataFrame:
    """For each row the nearest label row at or before it in ``order`` and the nearest that contradicts that one.

    Adds distances ``{name}_any`` (any candidate), ``{name}`` (a label), ``{name}_other`` (another label than ``{name}_label``).
    Running windows only, on one sort. A distance that does not fit its type is null, like one that does not exist.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lab = F.col("l_min").isNotNull()
    cand = F.col("n_cand") > 0 if cand is None else cand
    rows = rows.withColumns({
        "__last": F.last(F.when(lab, F.struct("ts", "l_min", "l_max")), True).over(before)})
    # the nearest point that holds another label than this row's: itself, the one before, or as for the one before
    differs = (F.col("__last.l_min") != F.col("l_min")) | (F.col("__last.l_max") != F.col("l_max"))
    other = F.when(lab, F.when(F.col("l_min") != F.col("l_max"), F.col("ts")).when(differs, F.col("__last.ts")))
    rows = rows.withColumn("__other", other)
    at = F.last(F.when(lab, F.struct("ts", "l_min")), True).over(w)
    rows = rows.withColumns({f"{name}_any": F.last(F.when(cand, F.col("ts")), True).over(w), "__at": at,
                             f"{name}_other": F.last("__other", True).over(w)})
    gap = {c: F.try_subtract(F.col("ts"), F.col(x)) if sign > 0 else F.try_subtract(F.col(x), F.col("ts")) for c, x in ((f"{name}_any", f"{name}_any"), (name, "__at.ts"), (f"{name}_other", f"{name}_other"))}
    return rows.withColumns({**gap, f"{name}_label": F.col("__at.l_min")}).drop("__last", "__other", "__at")


def _hot_keys(events: DataFrame, hot_rows: int) -> DataFrame | None:
    """(jkey, n_f, n_l) of the keys that have more than ``hot_rows`` of the ``events`` (jkey, kind); None if there are none.

    A bucket of keys has at least the rows of each of its keys, so the first count, a number per bucket and task, misses none.
    """
    bucket = F.pmod(F.xxhash64("jkey"), F.lit(COUNT_BUCKETS))
    full = materialize(events.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
                             .where(F.col("n") > hot_rows).select("bucket"), "match-full-buckets")
    if full.isEmpty():
        return None
    per = events.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("jkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == 1).alias("n_f"), F.count_if(F.col("kind") == 0).alias("n_l"))
    hot = materialize(per.where(F.col("n") > hot_rows).select("jkey", "n_f", "n_l"), "match-hot-keys")
    return None if hot.isEmpty() else hot


def _class_of(n: Column) -> Column:
    return F.when(n > 1, REPEATED).otherwise(UNIQUE)


def _answer_keys(events: DataFrame, tol: int) -> DataFrame:
    """Answers of keys with few rows: one shuffle by key, running windows over the key's rows in both directions of time.

    All labels within the tolerance agree exactly if it reaches the nearest label but not yet the nearest that contradicts it.
    """
    per_key = Window.partitionBy("jkey")
    rows = events.withColumns({"n_f": F.count_if(F.col("kind") == 1).over(per_key), "n_l": F.count_if(F.col("kind") == 0).over(per_key),
                               "l_min": F.col("l"), "l_max": F.col("l")})
    cand = (F.col("kind") == 0) & F.col("ts").isNotNull()
    rows = _side(rows, "back", [F.col("ts"), F.col("kind")], 1, ("jkey",), cand)
    rows = _side(rows, "ahead", [F.col("ts").desc(), F.col("kind")], -1, ("jkey",), cand).where(F.col("kind") > 0)
    differ = F.col("back").isNotNull() & F.col("ahead").isNotNull() & (F.col("back_label") != F.col("ahead_label"))
    clash = F.least("back_other", "ahead_other", F.when(differ, F.greatest("back", "ahead")))
    label = F.when(F.col("back") <= tol, F.col("back_label")).when(F.col("ahead") <= tol, F.col("ahead_label"))
    return rows.select(
        "jkey", "qkey", F.col("ts").alias("t"), "kind", label.alias("l_min"), label.alias("l_max"), F.coalesce(clash <= tol, F.lit(False)).alias("mixed"),
        F.when(F.least("back_any", "ahead_any") <= tol, _class_of(F.col("n_l"))).alias("cls_l"),
        F.when(F.col("kind") == 1, _class_of(F.col("n_f"))).alias("cls_f"))


def _answer_cells(events: DataFrame, hot: DataFrame, tol: int, integral: bool, sub_cell_ms: int) -> DataFrame:
    """Answers of the hot keys: rows added up to points, then the plan by time cells."""
    own = events.join(hot, "jkey")
    points = (own.where((F.col("kind") == 0) & F.col("ts").isNotNull()).groupBy("jkey", "ts")
                 .agg(F.min("l").alias("l_min"), F.max("l").alias("l_max"), F.count("l").alias("n_lab"),
                      F.count(F.lit(1)).alias("n_cand"), F.max(_class_of(F.col("n_l"))).alias("cls_l")))
    q = (own.where(F.col("kind") > 0)
            .groupBy(F.coalesce("qkey", "jkey").alias("qkey"), F.col("ts").alias("t"), "jkey",
                     F.when(F.col("kind") == 1, "F").otherwise("R").alias("dir"))
            .agg(F.max(F.when(F.col("kind") == 1, _class_of(F.col("n_f")))).alias("cls_f")))
    points, q, tols = materialize(points, "match-label-points"), materialize(q, "match-flow-points"), [(None, tol)]
    answered = (_answer_one_level(q, points, tols, integral) if tol <= sub_cell_ms
                else _answer_two_level(q, points, tols, integral, sub_cell_ms))
    return answered.select("qkey", "t", F.when(F.col("dir") == "F", 1).otherwise(2).alias("kind"), "l_min", "l_max",
                           F.lit(False).alias("mixed"), "cls_l", "cls_f")


def label_points(flows: DataFrame, labels: DataFrame, tolerance_ms: int, *, cardinality: str = "split",
                 directions: str = "both", flow_ts: str = FLOW_TS, label_ts: str = "ts_ms", scope=(),
                 sub_cell_ms: int = 3_600_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``flow_key, ts, label, match_pass`` of the flow points that get a label: :func:`match_points` without counts of candidates.

    Label rows and one probe per flow and direction are shuffled once by key. A key of more than ``hot_rows`` rows
    is answered by time cells, so no window holds more of a key.
    """
    tol = int(tolerance_ms)
    if cardinality not in ("split", "any"):
        raise ValueError("cardinality must be 'split' or 'any'")
    if directions not in ("both", "forward"):
        raise ValueError("directions must be 'both' or 'forward'")
    if tol < 0:
        raise ValueError("tolerances must be >= 0")
    flows, labels, f_ts, l_ts, integral = _prepare(flows, labels, flow_ts, label_ts)
    if scope:
        flows, labels = _scope_keys(flows, scope), _scope_keys(labels, scope)
    # kind 0: label row (without a time it only counts as an occurrence of its key), 1: flow at its key, 2: flow at its reverse key
    text = F.lit(None).cast("string")
    timed = flows.select("flow_key", "flow_key_rev", f_ts.alias("ts")).where(F.col("flow_key").isNotNull() & F.col("ts").isNotNull())
    events = (labels.select(F.col("flow_key").alias("jkey"), l_ts.alias("ts"), F.col("label").cast("string").alias("l"))
                    .where(F.col("jkey").isNotNull())
                    .select("jkey", "ts", F.lit(0).alias("kind"), F.when(F.col("ts").isNotNull(), F.col("l")).alias("l"), text.alias("qkey"))
                    .unionAll(timed.select(F.col("flow_key").alias("jkey"), "ts", F.lit(1).alias("kind"), text.alias("l"), text.alias("qkey"))))
    if directions == "both":
        events = events.unionAll(timed.where(F.col("flow_key_rev").isNotNull() & (F.col("flow_key_rev") != F.col("flow_key"))).select(
            F.col("flow_key_rev").alias("jkey"), "ts", F.lit(2).alias("kind"), text.alias("l"), F.col("flow_key").alias("qkey")))
    hot = _hot_keys(events.select("jkey", "kind"), hot_rows)
    few = events if hot is None else events.join(hot.select("jkey"), "jkey", "left_anti")
    answers = _answer_keys(few, tol)
    # forward answers lie by key already
    answers = (answers.drop("qkey").withColumnRenamed("jkey", "qkey") if directions == "forward"
               else answers.withColumn("qkey", F.coalesce("qkey", "jkey")).drop("jkey"))
    by = ["qkey", "t"]
    if hot is not None:
        answers = answers.unionByName(_answer_cells(events, hot, tol, integral, sub_cell_ms))
    if hot is not None or directions == "both":
        # grouped by one column more than the flows are joined on: the join gets an exchange of its own, and AQE can split it
        answers, by = answers.withColumn("spread", F.length("qkey")), [*by, "spread"]

    def of(agg, col, kind):
        return agg(F.when(F.col("kind") == kind, F.col(col)))
    per_point = answers.groupBy(*by).agg(F.max("cls_f").alias("cls_f"), *[e for d, k in (("F", 1), ("R", 2)) for e in (
        of(F.min, "l_min", k).alias(f"mn_{d}"), of(F.max, "l_max", k).alias(f"mx_{d}"),
        F.coalesce(of(F.max, "mixed", k), F.lit(False)).alias(f"mixed_{d}"), of(F.max, "cls_l", k).alias(f"cl_{d}"))])

    def ok(d):
        fits = F.lit(True) if cardinality == "any" else F.col(f"cl_{d}") == F.col("cls_f")
        return fits & ~F.col(f"mixed_{d}") & (F.col(f"mn_{d}") == F.col(f"mx_{d}"))
    prefix = F.when(F.col("cls_f") == UNIQUE, F.lit("u")).otherwise(F.lit("d"))
    return per_point.select(
        F.col("qkey").alias("flow_key"), F.col("t").alias("ts"), F.when(ok("F"), F.col("mn_F")).when(ok("R"), F.col("mn_R")).alias("label"),
        F.concat(prefix, F.when(ok("F"), F.lit("f")).otherwise(F.lit("r"))).alias("match_pass")).where(F.col("label").isNotNull())


def match_flows(flows: DataFrame, labels: DataFrame, tolerance_ms: int,
                *, cardinality: str = "split", directions: str = "both",
                flow_ts: str = FLOW_TS, label_ts: str = "ts_ms",
                keep_diagnostics: bool = False, scope=(), sub_cell_ms: int = 3_600_000,
                reuse_points: bool | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All flows with their columns plus ``label`` and ``match_pass``.

    The label is a function of ``(flow_key, ts)``, so it is joined back on that
    pair: no row identity is needed and the wide flow table is shuffled once.
    """
    if keep_diagnostics:
        res = match_points(flows, labels, tolerance_ms, cardinality=cardinality,
                           directions=directions, flow_ts=flow_ts, label_ts=label_ts, scope=scope,
                           sub_cell_ms=sub_cell_ms, reuse_points=reuse_points)
    else:
        res = label_points(flows, labels, tolerance_ms, cardinality=cardinality, directions=directions, flow_ts=flow_ts,
                           label_ts=label_ts, scope=scope, sub_cell_ms=sub_cell_ms, hot_rows=hot_rows)
    res = res.withColumnsRenamed({"flow_key": "__mk", "ts": "__mt"})
    if "flow_key" not in flows.columns:
        flows = with_flow_keys(flows)
    base = flows.drop(*[c for c in ("label", "match_pass") if c in flows.columns])
    base = base.withColumn("__ts", numeric_ts(base, flow_ts))
    base = base.withColumn("__fk", _scoped("flow_key", scope) if scope else F.col("flow_key"))
    cond = (base["__fk"] == res["__mk"]) & (base["__ts"] == res["__mt"])
    return base.join(res, cond, "left").drop("__mk", "__mt", "__ts", "__fk")


def _nested(q: DataFrame, points: DataFrame, tols: list, integral: bool, cardinality: str) -> DataFrame:
    """Per flow point (qkey, t, w): arrays ``ok`` and ``cand`` over the ascending tolerances, from one sorted pass.

    All labels within a tolerance agree exactly if it reaches the nearest label but not yet the nearest that
    contradicts it. Both distances hold for every tolerance, so each probe is sent once, to the cell of its time (as
    wide as the largest tolerance), and each label point to its own cell and the two beside it.
    """
    width = max(1, max(ms for _, ms in tols))

    def cell(c):
        return F.floor(c / width) if not integral else F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))
    no = F.lit(None)
    probes = q.select("jkey", cell(F.col("t")).cast("double").alias("cell"), F.col("t").alias("ts"), F.lit(1).alias("kind"), no.cast("string").alias("l_min"),
                      no.cast("string").alias("l_max"), no.cast("long").alias("n_lab"), no.cast("long").alias("n_cand"),
                      no.cast("int").alias("cls_l"), "qkey", "cls_f", "c", "dir")
    marks = points.select("jkey", F.explode(F.array(*[(cell(F.col("ts")) + d).cast("double") for d in (-1, 0, 1)])).alias("cell"), "ts", F.lit(0), "l_min",
                          "l_max", "n_lab", "n_cand", F.col("cls_l").cast("int"), no.cast("string"), no.cast("int"), no.cast("long"), no.cast("string"))
    rows = _side(probes.union(marks), "back", [F.col("ts"), F.col("kind")], 1)
    rows = _side(rows, "ahead", [F.col("ts").desc(), F.col("kind")], -1)
    # one class per label key, so any label row of the cells tells it
    rows = rows.withColumn("cls_l", F.max("cls_l").over(Window.partitionBy("jkey", "cell"))).where("kind = 1")
    near = F.least("back", "ahead")
    clash = F.least("back_other", "ahead_other", F.when(F.col("back_label") != F.col("ahead_label"), F.greatest("back", "ahead")))
    fits = F.lit(True) if cardinality == "any" else F.col("cls_l") == F.col("cls_f")

    def flags(cond):
        return [F.max(F.coalesce(fits & cond(F.lit(ms)), F.lit(False))) for _, ms in tols]
    return rows.groupBy("qkey", F.col("ts").alias("t")).agg(
        F.sum(F.when(F.col("dir") == "F", F.col("c"))).alias("w"),
        F.array(*flags(lambda ms: (near <= ms) & (clash.isNull() | (clash > ms)))).alias("ok"),
        F.array(*flags(lambda ms: F.least("back_any", "ahead_any") <= ms)).alias("cand"))


def tolerance_sweep(flows: DataFrame, labels: DataFrame, tolerances: dict[str, int] | None = None, *,
                    cardinality: str = "split", directions: str = "both", flow_ts: str = FLOW_TS, label_ts: str = "ts_ms",
                    scope=(), sub_cell_ms: int = 3_600_000) -> DataFrame:
    """Labelled flows and flows with candidates per named tolerance (J8); counts weight each flow point by its rows.

    Tolerances up to ``sub_cell_ms`` are answered together by one sorted pass (``_nested``); wider ones, whose cells could hold
    too many points of a hot key, by the sub-cell plan of :func:`match_points`, once for each tolerance.
    """
    tolerances = {n: int(ms) for n, ms in (tolerances or TIME_TOLERANCES).items()}
    if any(ms < 0 for ms in tolerances.values()):
        raise ValueError("tolerances must be >= 0")
    tols = list(tolerances.items())
    if max(tolerances.values()) <= sub_cell_ms:
        if scope:
            flows, labels = _scope_keys(flows, scope), _scope_keys(labels, scope)
        q, points, integral = _match_inputs(flows, labels, directions, flow_ts, label_ts, (), None)
        per = _nested(q, points, tols, integral, cardinality)
        one = per.agg(*[F.sum(F.when(F.col(c)[i], F.col("w"))).alias(f"{c}{i}") for c in ("ok", "cand") for i in range(len(tols))])
        rows = [F.struct(F.lit(n).alias("tolerance"), F.lit(ms).cast("bigint").alias("tolerance_ms"), F.coalesce(f"ok{i}", F.lit(0)).cast(
            "bigint").alias("labelled"), F.coalesce(f"cand{i}", F.lit(0)).cast("bigint").alias("with_candidates")) for i, (n, ms) in enumerate(tols)]
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    m = match_points(flows, labels, tolerances, cardinality=cardinality, directions=directions, flow_ts=flow_ts, label_ts=label_ts,
                     scope=scope, sub_cell_ms=sub_cell_ms)
    fv = _scope_keys(flows, scope) if scope else flows if "flow_key" in flows.columns else with_flow_keys(flows)
    counts = (fv.select("flow_key", numeric_ts(fv, flow_ts).alias("ts"))
                .where(F.col("flow_key").isNotNull() & F.col("ts").isNotNull())
                .groupBy("flow_key", "ts").agg(F.count(F.lit(1)).alias("w")))
    return (counts.join(m, ["flow_key", "ts"])
            .groupBy("tolerance", "tolerance_ms")
            .agg(F.sum(F.when(F.col("label").isNotNull(), F.col("w")).otherwise(0)).cast("bigint").alias("labelled"),
                 F.sum(F.when((F.col("n_cand_f") + F.col("n_cand_r")) > 0, F.col("w")).otherwise(0))
                  .cast("bigint").alias("with_candidates")))


def semi_join_keys(df: DataFrame, keys: DataFrame, key: str = "flow_key") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (J9): a left-semi join."""
    return df.join(keys.select(key).where(F.col(key).isNotNull()), on=key, how="left_semi")


def label_majority(matched: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Labels by key alone for flows that the time match left without one.

    ``matched`` is the result of :func:`match_flows`. A key seen once among the flows and once among the labels gives its
    label (``match_pass`` ``k1``). For other keys the label that makes up more than ``threshold`` of the key's label
    rows counts (``km``); rows without a label are in no share, and a tie at the top gives null whatever the threshold.
    Two aggregations of the labels (counts per key and label, then per key), joined on the key; no window over a key.
    """
    if not 0 <= threshold < 1:
        raise ValueError("threshold must be at least 0 and below 1")
    per = (labels.where(F.col("flow_key").isNotNull()).groupBy("flow_key", F.col("label").cast("string").alias("l"))
                 .agg(F.count(F.lit(1)).alias("n")))
    lab = F.col("l").isNotNull()
    top = per.groupBy("flow_key").agg(
        F.sum("n").alias("rows"), F.sum(F.when(lab, F.col("n"))).alias("labelled"),
        F.max(F.when(lab, F.struct("n", "l"))).alias("hi"), F.min(F.when(lab, F.struct((-F.col("n")).alias("m"), "l"))).alias("lo"))
    # the greatest and the smallest of the most frequent labels are the same unless there is a tie
    alone = F.when(F.col("hi.l") == F.col("lo.l"), F.col("hi.l"))
    share = F.col("hi.n") > F.col("labelled") * F.lit(float(threshold))
    top = materialize(top.select(F.col("flow_key").alias("__k"), F.col("rows").alias("__rows"), F.when(share, alone).alias("__label")),
                      "majority-labels")
    n_f = materialize(key_counts(matched, "flow_key", "__n_f").withColumnRenamed("flow_key", "__kf"), "majority-flow-counts")
    j = matched.join(top, F.col("flow_key") == F.col("__k"), "left").join(n_f, F.col("flow_key") == F.col("__kf"), "left")
    use = F.col("label").isNull() & F.col("__label").isNotNull()
    return j.withColumns({
        "match_pass": F.when(use, F.when((F.col("__n_f") == 1) & (F.col("__rows") == 1), "k1").otherwise("km")).otherwise(F.col("match_pass")),
        "label": F.coalesce("label", "__label")}).drop("__k", "__rows", "__label", "__kf", "__n_f")
