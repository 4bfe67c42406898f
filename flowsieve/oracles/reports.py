"""Oracles for reports, profiling, ordering and the matching side queries."""
from . import matching as MO
from .cleaning import LABEL_FILES
from .standins import F2, F5_FEATURES, F6_DURATIONS

FEATS = ["q", "p", "d", "t", "net", "d_null", "const"]
W5 = "WITH " + F5_FEATURES
LONG = W5 + f""",
long AS (UNPIVOT f5_features ON {", ".join(FEATS)} INTO NAME feature VALUE value)
"""
LONG_L = W5 + f""",
long AS (SELECT label, feature, value FROM (UNPIVOT f5_features ON {", ".join(FEATS)} INTO NAME feature VALUE value))
"""


def _matched() -> str:
    return f"({MO.match_flows()})"


def _corr_rows(upper_only: bool) -> str:
    sel = []
    for i, a in enumerate(FEATS):
        for b in FEATS[i:]:
            both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
            xa, xb = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
            sel.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, covar_pop({xa}, {xb}) AS c, "
                       f"var_pop({xa}) AS va, var_pop({xb}) AS vb FROM f5_features")
    body = "\nUNION ALL ".join(sel)
    out = W5 + f""",
m AS ({body}),
r AS (SELECT feature_a, feature_b,
             round(CASE WHEN va > 0 AND vb > 0 THEN greatest(-1.0, least(1.0, c / sqrt(va * vb))) END, 6) AS r
      FROM m)
"""
    if upper_only:
        return out
    return out + ", rr AS (SELECT * FROM r UNION ALL SELECT feature_b, feature_a, r FROM r WHERE feature_a <> feature_b)\n"


def _hist(bins: int, log: bool, by_label: bool) -> str:
    ids = "label, " if by_label else ""
    val = "ln(1 + value)" if log else "value"
    src = "long" if not by_label else "long"
    pre = LONG_L if by_label else LONG
    return pre + f""",
v AS (SELECT {ids}feature, {val} AS value FROM {src} WHERE value IS NOT NULL),
rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v GROUP BY feature),
b AS (SELECT v.*, rg.lo, rg.hi,
             CASE WHEN rg.hi = rg.lo THEN 1
                  ELSE least({bins}, CAST(floor((v.value - rg.lo) * {bins} / (rg.hi - rg.lo)) AS INTEGER) + 1) END AS bin
      FROM v JOIN rg USING (feature))
SELECT feature, {ids}bin, round(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / {bins}), 6) AS bin_lo,
       round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / {bins}), 6) AS bin_hi, count(*) AS n
FROM b GROUP BY feature, {ids}bin"""


def _box(by_label: bool) -> str:
    ids = "label, " if by_label else ""
    pre = LONG_L if by_label else LONG
    return pre + f""",
v AS (SELECT {ids}feature, value FROM long WHERE value IS NOT NULL),
q AS (SELECT {ids}feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM v GROUP BY {ids}feature),
q2 AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
e AS (SELECT {", ".join("v." + x.strip() for x in ids.split(",") if x.strip())}{", " if by_label else ""}v.feature,
             min(CASE WHEN v.value BETWEEN q2.lower_fence AND q2.upper_fence THEN v.value END) AS whisker_low,
             max(CASE WHEN v.value BETWEEN q2.lower_fence AND q2.upper_fence THEN v.value END) AS whisker_high,
             count(*) FILTER (WHERE NOT (v.value BETWEEN q2.lower_fence AND q2.upper_fence)) AS n_outliers
      FROM v JOIN q2 ON v.feature = q2.feature {"AND v.label = q2.label" if by_label else ""}
      GROUP BY {", ".join("v." + x.strip() for x in ids.split(",") if x.strip())}{", " if by_label else ""}v.feature)
SELECT q2.feature, {"q2.label, " if by_label else ""}q2.n, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence,
       round(upper_fence, 6) AS upper_fence, round(whisker_low, 6) AS whisker_low,
       round(whisker_high, 6) AS whisker_high, n_outliers
FROM q2 JOIN e ON q2.feature = e.feature {"AND q2.label = e.label" if by_label else ""}"""


_ROW_KEY = "md5(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN 'n|' ELSE length(CAST({c} AS VARCHAR)) || ':' || {c} || '|' END"
    for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) + " || '{seed}')"

MI_BINNED = _hist(25, False, True).split("\nSELECT feature, label, bin")[0] + """,
cell AS (SELECT feature, bin, label, count(*) AS n_bl FROM b WHERE label IS NOT NULL GROUP BY ALL),
t AS (SELECT c.*, sum(n_bl) OVER (PARTITION BY feature) AS n,
             sum(n_bl) OVER (PARTITION BY feature, bin) AS n_b,
             sum(n_bl) OVER (PARTITION BY feature, label) AS n_l FROM cell c)
SELECT feature, round(greatest(sum((n_bl::DOUBLE / n) * ln(n_bl::DOUBLE * n / (n_b::DOUBLE * n_l))), 0.0), 6) AS mi
FROM t GROUP BY feature"""

_PASS = """
SELECT f.flow_id, m.label FROM f2_flows f JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts
WHERE m.match_pass = '{p}'"""


def _pass(p: str) -> str:
    return MO._f2_match() + _PASS.format(p=p)


def _sweep() -> str:
    from ..operators.matching import TIME_TOLERANCES
    parts = []
    for name, tol in TIME_TOLERANCES.items():
        body = MO.match_sql("f2_flows", "f2_labels", tol).replace("\nfv AS", f"\nfv_{name} AS", 1)
        # each tolerance as its own sub-query
        parts.append(f"""(WITH {F2.strip()}{MO.match_sql("f2_flows", "f2_labels", tol)}
SELECT '{name}' AS tolerance, CAST({tol} AS BIGINT) AS tolerance_ms,
       count(*) FILTER (WHERE m.label IS NOT NULL) AS labelled,
       count(*) FILTER (WHERE m.n_cand_f + m.n_cand_r > 0) AS with_candidates
FROM f2_flows f JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts)""")
    return "\nUNION ALL\n".join(parts)


def _psi(x: str) -> str:
    """Digamma of a positive number as SQL: recurrence to x + 6, then the asymptotic series."""
    y = f"({x} + 6.0)"
    low = " + ".join(f"1.0 / ({x} + {i}.0)" for i in range(6))
    return (f"(ln({y}) - 0.5 / {y} - 1.0 / (12 * {y} ** 2) + 1.0 / (120 * {y} ** 4) - 1.0 / (252 * {y} ** 6) "
            f"+ 1.0 / (240 * {y} ** 8) - ({low}))")


def _knn(k_max: int = 3) -> str:
    """k-NN mutual information without noise: neighbours by lag and lead, counts by a running sum."""
    shifts = ", ".join(f"lag(value, {j}) OVER w AS a{j}, lead(value, {j}) OVER w AS b{j}" for j in range(1, k_max + 1))

    def dist(k):
        ways = []
        for j in range(k + 1):
            side = [c for c, on in ((f"a{j}", j), (f"b{k - j}", k - j)) if on]
            gap = [g for g, on in ((f"value - a{j}", j), (f"b{k - j} - value", k - j)) if on]
            ways.append(f"CASE WHEN {' AND '.join(c + ' IS NOT NULL' for c in side)} THEN "
                        + (f"greatest({gap[0]}, {gap[1]})" if len(gap) == 2 else gap[0]) + " END")
        return f"least({', '.join(ways)})"
    r = "CASE " + " ".join(f"WHEN k = {k} THEN {dist(k)}" for k in range(1, k_max + 1)) + " END"
    return W5 + f""",
f5r AS (SELECT *, row_number() OVER () AS rid FROM f5_features),
long AS (SELECT rid, label, feature, value FROM (UNPIVOT f5r ON {", ".join(FEATS)} INTO NAME feature VALUE value)
         WHERE label IS NOT NULL AND value IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS n_c, {shifts}
      FROM long WINDOW w AS (PARTITION BY feature, label ORDER BY value)),
d0 AS (SELECT *, least({k_max}, n_c - 1) AS k FROM c WHERE n_c >= 2),
d AS (SELECT feature, rid, value, k, n_c, {r} AS r FROM d0),
p AS (SELECT feature, rid, value AS v, 0 AS tb, 1 AS is_data, 0 AS sign FROM d
      UNION ALL SELECT feature, rid, value + r, CASE WHEN r = 0 THEN 1 ELSE -1 END, 0, 1 FROM d
      UNION ALL SELECT feature, rid, value - r, CASE WHEN r = 0 THEN -1 ELSE 1 END, 0, -1 FROM d),
cu AS (SELECT *, sum(is_data) OVER (PARTITION BY feature ORDER BY v, tb ROWS UNBOUNDED PRECEDING) AS upto FROM p),
m AS (SELECT feature, rid, CAST(sum(sign * upto) AS BIGINT) AS m FROM cu WHERE is_data = 0 GROUP BY feature, rid)
SELECT feature, round(greatest({_psi("CAST(count(*) AS DOUBLE)")} + avg({_psi("k")}) - avg({_psi("n_c")}) - avg({_psi("m")}), 0.0), 6) AS mi
FROM d JOIN m USING (feature, rid) GROUP BY feature"""


ORACLES = {
    "mutual_information_knn_all": _knn(),
    "flow_label_report": "WITH " + F2 + """
SELECT 'rows' AS item, 'flows' AS name, count(*) AS n FROM f2_flows
UNION ALL SELECT 'rows', 'labels', count(*) FROM f2_labels
UNION ALL SELECT 'label', label, count(*) FROM f2_labels GROUP BY label
UNION ALL VALUES """ + ", ".join(
        f"('{k} column', '{c}', CAST({i} AS BIGINT))" for k, cols in (
            ("flows", "flow_id src_ip dst_ip src_port dst_port protocol bidirectional_first_seen_ms flow_key flow_key_rev"),
            ("labels", "label_id ts_ms label flow_key")) for i, c in enumerate(cols.split(), 1)),
    "build_dataset_report": f"""
WITH x AS (SELECT coalesce(match_pass, 'none') AS match_pass, count(*) AS n FROM {_matched()} GROUP BY 1)
SELECT match_pass, n, round(CASE WHEN sum(n) OVER () > 0 THEN n / sum(n) OVER () ELSE 0 END, 6) AS rate FROM x""",
    "label_distribution": W5 + "\nSELECT label, count(*) AS n FROM f5_features WHERE label IS NOT NULL GROUP BY label",
    "label_distribution_nulls": f"SELECT label, count(*) AS n FROM {_matched()} GROUP BY label",
    "distinct_keys": "WITH " + F2 + "\nSELECT count(DISTINCT flow_key) AS n_distinct_flow_key FROM f2_all_labels",
    "key_ambiguity": "WITH " + F2 + """,
k AS (SELECT flow_key, count(*) AS n, count(DISTINCT label) AS n_labels FROM f2_all_labels
      WHERE flow_key IS NOT NULL GROUP BY flow_key),
s AS (SELECT count(*) AS distinct_keys, count(*) FILTER (WHERE n = 1) AS keys_once,
             count(*) FILTER (WHERE n > 1) AS keys_repeated,
             CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_of_repeated_keys,
             count(*) FILTER (WHERE n > 1 AND n_labels > 1) AS conflicting_keys,
             CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM k)
SELECT distinct_keys, keys_once, keys_repeated, rows_of_repeated_keys, conflicting_keys,
       round(CASE WHEN distinct_keys > 0 THEN keys_once * 100.0 / distinct_keys END, 6) AS pct_keys_once,
       round(CASE WHEN distinct_keys > 0 THEN keys_repeated * 100.0 / distinct_keys END, 6) AS pct_keys_repeated,
       round(CASE WHEN rows > 0 THEN rows_of_repeated_keys * 100.0 / rows END, 6) AS pct_rows_of_repeated_keys,
       round(CASE WHEN keys_repeated > 0 THEN conflicting_keys * 100.0 / keys_repeated END, 6) AS pct_conflicting_of_repeated,
       round(CASE WHEN distinct_keys > 0 THEN conflicting_keys * 100.0 / distinct_keys END, 6) AS pct_conflicting_of_keys
FROM s""",
    "conflict_detail": "WITH " + F2 + """,
c AS (SELECT flow_key, label, count(*) AS n FROM f2_all_labels WHERE flow_key IS NOT NULL GROUP BY flow_key, label),
k AS (SELECT flow_key FROM c GROUP BY flow_key HAVING sum(n) > 1 AND count(label) > 1)
SELECT c.* FROM c WHERE flow_key IN (SELECT flow_key FROM k)""",
    "flow_label_ratio": "WITH " + F2 + """
SELECT (SELECT count(*) FROM f2_flows) AS n_flows, (SELECT count(*) FROM f2_labels) AS n_labels,
       round((SELECT count(*) FROM f2_flows)::DOUBLE / nullif((SELECT count(*) FROM f2_labels), 0), 3) AS flows_per_label""",
    "label_counts_by_stage": MO._f2_match() + """
SELECT label, count(*) AS n, 'labels' AS stage FROM f2_labels GROUP BY label
UNION ALL
SELECT m.label, count(*) AS n, 'processed' AS stage
FROM f2_flows f JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts
WHERE m.label IS NOT NULL GROUP BY m.label""",
    "build_dataset": MO._f2_match() + """
SELECT f.*, m.label, m.match_pass, 'events_flows' AS dataset_name
FROM f2_flows f JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts
WHERE m.label IS NOT NULL""",
    "duration_histogram": "WITH " + F6_DURATIONS + """,
d AS (SELECT CAST(flow_duration_us AS DOUBLE) AS d FROM f6_durations WHERE flow_duration_us IS NOT NULL),
r(range_id, range_label, lo, hi) AS (VALUES (0, '0-1ms', -1, 1000), (1, '1-10ms', 1000, 10000),
  (2, '10-100ms', 10000, 100000), (3, '100ms-1s', 100000, 1000000), (4, '1s-10s', 1000000, 10000000),
  (5, '10s-1min', 10000000, 60000000), (6, '1-2min', 60000000, 120000000),
  (7, '2-5min', 120000000, 300000000), (8, '5min+', 300000000, 9e18))
SELECT r.range_id, r.range_label, count(d.d) AS n,
       round(count(d.d) * 100.0 / (SELECT count(*) FROM d), 2) AS pct
FROM r LEFT JOIN d ON (CASE WHEN r.range_id = 0 THEN d.d >= 0 ELSE d.d > r.lo END) AND d.d <= r.hi
GROUP BY r.range_id, r.range_label""",
    "duration_range": "WITH " + F6_DURATIONS + """
SELECT min(flow_duration_us)::DOUBLE AS min_us, max(flow_duration_us)::DOUBLE AS max_us,
       round(max(flow_duration_us) / 1000000.0, 2) AS max_s, round(max(flow_duration_us) / 60000000.0, 2) AS max_min
FROM f6_durations""",
    "null_percentage": W5 + "\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0, 6) AS null_pct FROM f5_features"
        for c in FEATS + ["label"]),
    "duplicate_row_count": "WITH " + LABEL_FILES + """,
g AS (SELECT count(*) AS n FROM cat GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicated FROM g"""
    .replace("GROUP BY ALL", 'GROUP BY "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Timestamp", "Label"'),
    "match_rate": f"""
WITH x AS (SELECT coalesce(match_pass, 'none') AS match_pass, count(*) AS n FROM {_matched()} GROUP BY 1)
SELECT match_pass, n, round(CASE WHEN sum(n) OVER () > 0 THEN n / sum(n) OVER () ELSE 0 END, 6) AS rate FROM x""",
    "table_profile": """
SELECT column_name, dtype, non_null, n_rows FROM (
  SELECT 'event_id' AS column_name, 'bigint' AS dtype, count(event_id) AS non_null, count(*) AS n_rows FROM events
  UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts), count(*) FROM events
  UNION ALL SELECT 'user_id', 'bigint', count(user_id), count(*) FROM events
  UNION ALL SELECT 'event_type', 'string', count(event_type), count(*) FROM events
  UNION ALL SELECT 'value', 'double', count(value), count(*) FROM events
  UNION ALL SELECT 'props', 'string', count(props), count(*) FROM events)""",
    "describe_features": LONG + """,
n AS (SELECT DISTINCT feature FROM (UNPIVOT f5_features ON """ + ", ".join(FEATS) + """ INTO NAME feature VALUE value) ),
a AS (SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
             quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
             max(value) AS max FROM long WHERE value IS NOT NULL GROUP BY feature)
SELECT feature, count, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(q25, 6) AS q25,
       round(q50, 6) AS q50, round(q75, 6) AS q75, round(max, 6) AS max FROM a""",
    "feature_dispersion": LONG + """,
a AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std FROM long WHERE value IS NOT NULL GROUP BY feature)
SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std,
       round(CASE WHEN mean <> 0 THEN std / mean WHEN std > 0 THEN 'inf'::DOUBLE END, 6) AS cv,
       abs(mean) >= 0.01 AS cv_reliable FROM a""",
    "correlation_matrix": _corr_rows(False) + "SELECT * FROM rr",
    "high_correlation_pairs": _corr_rows(True) + """
SELECT feature_a, feature_b, r, abs(r) AS abs_r FROM r WHERE feature_a <> feature_b AND abs(r) >= 0.9""",
    "histogram": _hist(25, False, False),
    "histogram_by_label": _hist(10, True, True),
    "boxplot_stats": _box(False),
    "boxplot_by_label": _box(True),
    "unpivot_features": W5 + f"""
SELECT label, feature, value FROM f5_features UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(FEATS)}))""",
    "select_features": W5 + f"\nSELECT {', '.join(FEATS)} FROM f5_features",
    "label_encode": W5 + """,
c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_code FROM (SELECT DISTINCT label FROM f5_features WHERE label IS NOT NULL))
SELECT f.label, c.label_code, f.p FROM f5_features f LEFT JOIN c USING (label)""",
    "mutual_information_binned": MI_BINNED,
    "top_features": f"SELECT * FROM ({MI_BINNED}) ORDER BY mi DESC NULLS LAST, feature LIMIT 15",
    "preview_rows": "WITH " + F2 + "\nSELECT * FROM f2_all_flows ORDER BY flow_id LIMIT 10",
    "sample_fixed_n": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag
FROM (SELECT * REPLACE (CASE WHEN l_partkey % 10 <> 3 THEN l_partkey END AS l_partkey) FROM lineitem)
ORDER BY """ + _ROW_KEY.format(seed=42) + " LIMIT 3000",
    "sample_column_values": """
SELECT l_extendedprice FROM lineitem
ORDER BY """ + _ROW_KEY.format(seed=7) + " LIMIT 10",
    "split_key_counts": "WITH " + F2 + """,
k AS (SELECT flow_key, count(*) AS key_count FROM f2_all_labels WHERE flow_key IS NOT NULL GROUP BY flow_key)
SELECT l.label_id, l.flow_key, k.key_count,
       CASE WHEN k.key_count = 1 THEN 'unique' WHEN k.key_count > 1 THEN 'repeated' END AS key_class
FROM f2_all_labels l LEFT JOIN k USING (flow_key)""",
    "semi_join_keys": "WITH " + F2 + """
SELECT * FROM f2_flows WHERE flow_key IN (SELECT flow_key FROM f2_labels WHERE flow_key IS NOT NULL)""",
    "match_unique_forward": _pass("uf"),
    "match_unique_reverse": _pass("ur"),
    "match_duplicate_consensus": _pass("df"),
    "match_duplicate_reverse": _pass("dr"),
    "tolerance_sweep": _sweep(),
}
