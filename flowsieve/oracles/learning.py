"""Oracles of labelling fallbacks, streams, split, scores, vectors and exploration."""
from . import matching as M
from .standins import F2

F8 = """
f8_classes AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t,
         CASE WHEN l_partkey % 11 = 0 THEN 'low' WHEN l_extendedprice * (1 - l_discount) > 40000 THEN 'high'
              WHEN l_quantity < 12 THEN 'low' ELSE 'mid' END AS label,
         'o' || l_orderkey AS a, 's' || l_suppkey AS b, l_linenumber % 2 = 1 AS odd FROM lineitem),
f8 AS (SELECT * EXCLUDE (a, b, odd), CASE WHEN odd THEN a || '|' || b ELSE b || '|' || a END AS flow_key,
              CASE WHEN odd THEN b || '|' || a ELSE a || '|' || b END AS flow_key_rev FROM f8_classes)"""

F9 = F2 + """,
f9_flows AS (SELECT * EXCLUDE (flow_key, flow_key_rev), src_ip || '|' || (flow_id % 2) AS flow_key FROM f2_flows),
f9_labels AS (SELECT event_id AS label_id, ts_ms, CASE WHEN event_id % 12 = 5 THEN NULL WHEN event_id % 3 <> 0 THEN 'view'
                     ELSE event_type END AS label, a || '|' || (event_id % 2) AS flow_key
              FROM f2_base WHERE (event_id // 16) % 2 = 1)"""


def label_stream() -> str:
    return "WITH " + F2 + M.match_sql("f2_flows", "f2_labels", M.F2_TOL, both=False, cardinality="any") + """
SELECT f.*, m.label, coalesce(m.n_cand_f, 0) AS n_candidates
FROM f2_flows f LEFT JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts"""


def label_majority() -> str:
    return "WITH " + F9 + M.match_sql("f9_flows", "f9_labels", 60_000, both=False) + """,
per AS (SELECT flow_key, label, count(*) AS n FROM f9_labels WHERE label IS NOT NULL GROUP BY ALL),
tot AS (SELECT flow_key, count(*) AS r, count(label) AS t FROM f9_labels GROUP BY ALL),
win AS (SELECT flow_key, label FROM per JOIN tot USING (flow_key) WHERE n > t * CAST(0.7 AS DOUBLE)),
cnt AS (SELECT flow_key, count(*) AS c FROM f9_flows GROUP BY ALL)
SELECT f.flow_id, coalesce(m.label, win.label) AS label,
       CASE WHEN m.label IS NOT NULL THEN m.match_pass WHEN win.label IS NULL THEN NULL
            WHEN cnt.c = 1 AND tot.r = 1 THEN 'k1' ELSE 'km' END AS match_pass
FROM f9_flows f LEFT JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts
LEFT JOIN win ON win.flow_key = f.flow_key LEFT JOIN tot ON tot.flow_key = f.flow_key LEFT JOIN cnt ON cnt.flow_key = f.flow_key"""


TRAIN_TEST_SPLIT = "WITH " + F8 + """,
c AS (SELECT *, least(flow_key, flow_key_rev) AS conv FROM f8),
per AS (SELECT conv, label, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT conv, sum(n) AS n, arg_min(label, (-n, label)) AS stratum FROM per GROUP BY conv),
r AS (SELECT conv, sum(n) OVER (PARTITION BY stratum ORDER BY md5(conv || '|42'), conv ROWS UNBOUNDED PRECEDING) AS upto,
             sum(n) OVER (PARTITION BY stratum) AS total FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, flow_key, label,
       CASE WHEN upto <= total * CAST(0.2 AS DOUBLE) THEN 'test' ELSE 'train' END AS part FROM c JOIN r USING (conv)"""

CLASSIFICATION_METRICS = "WITH " + F8 + """,
x AS (SELECT label, CASE WHEN l_linenumber = 7 THEN NULL WHEN q < 12 THEN 'low' WHEN p > 60000 THEN 'top' ELSE 'mid' END AS pred FROM f8),
k AS (SELECT label AS class FROM x UNION SELECT pred FROM x WHERE pred IS NOT NULL),
s AS (SELECT class, (SELECT count(*) FROM x WHERE label = class AND pred = class) AS hit,
             (SELECT count(*) FROM x WHERE label = class) AS support, (SELECT count(*) FROM x WHERE pred = class) AS predicted FROM k),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS re,
             2.0 * hit / (support + predicted) AS f FROM s)
SELECT 'class' AS kind, class, round(CAST(pr AS DOUBLE), 6) AS precision, round(CAST(re AS DOUBLE), 6) AS recall,
       round(CAST(f AS DOUBLE), 6) AS f1, support FROM m
UNION ALL SELECT 'macro', NULL, round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'micro', NULL, round(sum(hit) / sum(predicted), 6), round(sum(hit) / sum(support), 6),
       round(2 * sum(hit) / (sum(support) + sum(predicted)), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted', NULL, round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
       round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m"""

_VEC = ["q", "p", "d", "t"]
FEATURE_VECTORS = "WITH " + F8 + ", fit AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _VEC) + """ FROM f8)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, position, round(value, 6) AS value FROM (
""" + "\nUNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {i} AS position, "
    + (f"CASE WHEN l_linenumber = 3 THEN m_{c} ELSE {c} END" if c == "p" else c) + f" / s_{c} AS value FROM f8, fit"
    for i, c in enumerate(_VEC)) + ") WHERE value <> 0"


def explore(reports: dict[str, str]) -> str:
    """The single reports' SQL, laid under each other."""
    def part(report, sql, item, other, stats):
        it, ot = (f"CAST({c} AS VARCHAR)" if c else "CAST(NULL AS VARCHAR)" for c in (item, other))
        return "\nUNION ALL ".join(f"SELECT '{report}' AS report, {it} AS item, {ot} AS other, '{s}' AS stat, CAST({s} AS DOUBLE) AS value FROM ({sql})"
                                   for s in stats)
    return "\nUNION ALL ".join([
        part("rows", "SELECT count(*) AS n FROM lineitem", None, None, ["n"]),
        part("nulls", reports["null_percentage"], "column_name", None, ["null_pct"]),
        part("classes", reports["label_distribution"], "label", None, ["n"]),
        part("describe", reports["describe_features"], "feature", None, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
        part("dispersion", reports["feature_dispersion"], "feature", None, ["cv"]),
        part("histogram", reports["histogram"], "feature", "bin", ["n"]),
        part("boxplot", reports["boxplot_stats"], "feature", None, ["whisker_low", "whisker_high", "n_outliers"]),
        part("correlation", reports["high_correlation_pairs"], "feature_a", "feature_b", ["r"]),
        part("information", reports["mutual_information_binned"], "feature", None, ["mi"]),
        part("top", reports["top_features"], "feature", None, ["mi"])])
