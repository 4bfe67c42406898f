"""Brute-force matching oracle: all candidate pairs, then GROUP BY."""
from .standins import F2, F3


def match_sql(flows: str, labels: str, tol: int, *, flow_ts: str = "bidirectional_first_seen_ms",
              label_ts: str = "ts_ms", both: bool = True, cardinality: str = "split") -> str:
    """CTE text ending in ``m(flow_key, ts, label, match_pass, n_cand_f, n_cand_r)``."""
    same = "TRUE" if cardinality == "any" else "((p.n_f = 1) = (n.n_l = 1))"
    rev = "" if not both else f"""
  UNION ALL
  SELECT p.flow_key, p.ts, 'R' AS dir, p.n_f, l.label, n.n_l
  FROM pts p JOIN lv l ON l.flow_key = p.flow_key_rev AND p.flow_key_rev <> p.flow_key
       AND l.ts IS NOT NULL AND abs(l.ts - p.ts) <= {tol}
  JOIN nl n ON n.flow_key = l.flow_key WHERE {same}"""
    rev_key = "flow_key_rev" if both else "NULL AS flow_key_rev"
    return f""",
fv AS (SELECT flow_key, {rev_key}, {flow_ts} AS ts FROM {flows}
       WHERE flow_key IS NOT NULL AND {flow_ts} IS NOT NULL),
nf AS (SELECT flow_key, count(*) AS n_f FROM fv GROUP BY flow_key),
lv AS (SELECT flow_key, {label_ts} AS ts, label FROM {labels} WHERE flow_key IS NOT NULL),
nl AS (SELECT flow_key, count(*) AS n_l FROM lv GROUP BY flow_key),
pts AS (SELECT DISTINCT fv.flow_key, fv.flow_key_rev, fv.ts, nf.n_f FROM fv JOIN nf USING (flow_key)),
cand AS (
  SELECT p.flow_key, p.ts, 'F' AS dir, p.n_f, l.label, n.n_l
  FROM pts p JOIN lv l ON l.flow_key = p.flow_key AND l.ts IS NOT NULL AND abs(l.ts - p.ts) <= {tol}
  JOIN nl n ON n.flow_key = l.flow_key WHERE {same}{rev}),
agg AS (
  SELECT flow_key, ts, any_value(n_f) AS n_f,
         count(DISTINCT label) FILTER (WHERE dir = 'F') AS nd_f, min(label) FILTER (WHERE dir = 'F') AS l_f,
         count(DISTINCT label) FILTER (WHERE dir = 'R') AS nd_r, min(label) FILTER (WHERE dir = 'R') AS l_r,
         count(*) FILTER (WHERE dir = 'F') AS n_cand_f, count(*) FILTER (WHERE dir = 'R') AS n_cand_r
  FROM cand GROUP BY flow_key, ts),
m AS (
  SELECT flow_key, ts,
         CASE WHEN nd_f = 1 THEN l_f WHEN nd_r = 1 THEN l_r END AS label,
         CASE WHEN nd_f = 1 THEN (CASE WHEN n_f = 1 THEN 'u' ELSE 'd' END) || 'f'
              WHEN nd_r = 1 THEN (CASE WHEN n_f = 1 THEN 'u' ELSE 'd' END) || 'r' END AS match_pass,
         n_cand_f, n_cand_r
  FROM agg)
"""


F2_TOL = 86_400_000
F3_TOL = 15_552_000_000

def _f2_match(cardinality="split", tol=F2_TOL) -> str:
    return "WITH " + F2 + match_sql("f2_flows", "f2_labels", tol, cardinality=cardinality)


def match_flows() -> str:
    return _f2_match() + """
SELECT f.*, m.label, m.match_pass
FROM f2_flows f LEFT JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts"""


def match_flows_1min() -> str:
    return _f2_match(tol=60_000) + """
SELECT f.*, m.label, m.match_pass
FROM f2_flows f LEFT JOIN m ON f.flow_key = m.flow_key AND f.bidirectional_first_seen_ms = m.ts"""


def match_flows_large() -> str:
    return "WITH " + F3 + match_sql("f3_flows", "f3_labels", F3_TOL, flow_ts="ts_ms", both=False) + """
SELECT f.*, m.label, m.match_pass
FROM f3_flows f LEFT JOIN m ON f.flow_key = m.flow_key AND f.ts_ms = m.ts"""
