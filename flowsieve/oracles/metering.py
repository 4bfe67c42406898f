"""Flow metering oracle: a recursive CTE walks each idle session point by point."""
from .standins import F1_PACKETS

IDLE, ACTIVE = 21_600_000, 86_400_000


def assigned(idle: int = IDLE, active: int = ACTIVE, scope: str = "", packets: str = F1_PACKETS) -> str:
    """CTE text ending in ``pf``: packets with conversation and flow start."""
    sc = f"{scope}, " if scope else ""
    on_sc = "".join(f" AND s.{c.strip()} = w.{c.strip()}" for c in scope.split(",") if c.strip())
    on_pt = "".join(f" AND p.{c.strip()} = t.{c.strip()}" for c in scope.split(",") if c.strip())
    return "WITH RECURSIVE " + packets + f""",
pk AS (
  SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND coalesce(src_port, -1) <= coalesce(dst_port, -1))) AS a_sends FROM f1_packets),
pk2 AS (
  SELECT *, CASE WHEN a_sends THEN src_ip ELSE dst_ip END AS a_ip, coalesce(CASE WHEN a_sends THEN src_port ELSE dst_port END, -1) AS a_port,
         CASE WHEN a_sends THEN dst_ip ELSE src_ip END AS b_ip, coalesce(CASE WHEN a_sends THEN dst_port ELSE src_port END, -1) AS b_port
  FROM pk),
pts AS (SELECT DISTINCT {sc}a_ip, a_port, b_ip, b_port, protocol, ts_ms AS ts FROM pk2 WHERE ts_ms IS NOT NULL),
s1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= {idle} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS is_new
       FROM pts WINDOW w AS (PARTITION BY {sc}a_ip, a_port, b_ip, b_port, protocol ORDER BY ts)),
s2 AS (SELECT *, sum(is_new) OVER (PARTITION BY {sc}a_ip, a_port, b_ip, b_port, protocol ORDER BY ts
                                   ROWS UNBOUNDED PRECEDING) AS sid FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY {sc}a_ip, a_port, b_ip, b_port, protocol, sid ORDER BY ts) AS rn FROM s2),
walk AS (
  SELECT {sc}a_ip, a_port, b_ip, b_port, protocol, sid, rn, ts, ts AS flow_start FROM s3 WHERE rn = 1
  UNION ALL
  SELECT {"".join("s." + c.strip() + ", " for c in scope.split(",") if c.strip())}s.a_ip, s.a_port, s.b_ip, s.b_port, s.protocol, s.sid, s.rn, s.ts,
         CASE WHEN s.ts - w.flow_start >= {active} THEN s.ts ELSE w.flow_start END
  FROM walk w JOIN s3 s ON s.a_ip = w.a_ip AND s.a_port = w.a_port AND s.b_ip = w.b_ip AND s.b_port = w.b_port
       AND s.protocol = w.protocol AND s.sid = w.sid AND s.rn = w.rn + 1{on_sc}),
fl AS (SELECT *, CASE WHEN lead(flow_start) OVER (PARTITION BY {sc}a_ip, a_port, b_ip, b_port, protocol, sid ORDER BY ts)
                         <> flow_start THEN 1 ELSE 0 END AS cut_here FROM walk),
fe AS (SELECT {sc}a_ip, a_port, b_ip, b_port, protocol, flow_start, max(cut_here) AS expiration_id
       FROM fl GROUP BY ALL),
pt AS (SELECT DISTINCT {"".join("w." + c.strip() + ", " for c in scope.split(",") if c.strip())}w.a_ip, w.a_port, w.b_ip, w.b_port, w.protocol, w.ts, w.flow_start, fe.expiration_id
       FROM walk w JOIN fe USING ({sc}a_ip, a_port, b_ip, b_port, protocol, flow_start)),
pf AS (SELECT p.*, t.flow_start, t.expiration_id FROM pk2 p JOIN pt t
       ON p.a_ip = t.a_ip AND p.a_port = t.a_port AND p.b_ip = t.b_ip AND p.b_port = t.b_port
       AND p.protocol = t.protocol AND p.ts_ms = t.ts{on_pt})
"""


_KEY = "a_ip, a_port, b_ip, b_port, protocol, flow_start"


def meter_flows(scope: str = "", packets: str = F1_PACKETS) -> str:
    key = f"{scope}, {_KEY}" if scope else _KEY
    sel = f"{scope}, " if scope else ""
    return assigned(scope=scope, packets=packets) + f"""
SELECT {sel}arg_min(src_ip, (ts_ms, packet_id)) AS src_ip, arg_min(dst_ip, (ts_ms, packet_id)) AS dst_ip,
       arg_min(src_port, (ts_ms, packet_id)) AS src_port, arg_min(dst_port, (ts_ms, packet_id)) AS dst_port,
       protocol, min(ts_ms) AS bidirectional_first_seen_ms, max(ts_ms) AS bidirectional_last_seen_ms,
       max(ts_ms) - min(ts_ms) AS bidirectional_duration_ms, count(*) AS bidirectional_packets,
       CAST(sum(bytes) AS BIGINT) AS bidirectional_bytes, max(expiration_id) AS expiration_id
FROM pf GROUP BY {key}"""


F1_CAPTURES = F1_PACKETS.replace("f1_packets AS (", "f1_raw AS (") + """,
f1_packets AS (SELECT *, CAST(packet_id % 3 AS INTEGER) AS capture FROM f1_raw)"""


def meter_expiration() -> str:
    return f"SELECT expiration_id, count(*) AS n FROM ({meter_flows()}) GROUP BY expiration_id"


def _dir(prefix: str, cond: str) -> str:
    ts = f"CASE WHEN {cond} THEN ts_ms END"
    sz = f"CASE WHEN {cond} THEN bytes END"
    pi = f"CASE WHEN {cond} THEN {'piat_bi' if prefix == 'bidirectional' else 'piat_dir'} END"
    return f"""min({ts}) AS {prefix}_first_seen_ms, max({ts}) AS {prefix}_last_seen_ms,
       max({ts}) - min({ts}) AS {prefix}_duration_ms, count({ts}) AS {prefix}_packets,
       CAST(coalesce(sum({sz}), 0) AS BIGINT) AS {prefix}_bytes, min({sz}) AS {prefix}_min_ps,
       round(avg({sz}), 6) AS {prefix}_mean_ps, round(stddev_samp({sz}), 6) AS {prefix}_stddev_ps,
       max({sz}) AS {prefix}_max_ps, min({pi}) AS {prefix}_min_piat_ms, round(avg({pi}), 6) AS {prefix}_mean_piat_ms,
       round(stddev_samp({pi}), 6) AS {prefix}_stddev_piat_ms, max({pi}) AS {prefix}_max_piat_ms"""


STAT_NAMES = ["first_seen_ms", "last_seen_ms", "duration_ms", "packets", "bytes", "min_ps", "mean_ps",
              "stddev_ps", "max_ps", "min_piat_ms", "mean_piat_ms", "stddev_piat_ms", "max_piat_ms"]


def flow_stats() -> str:
    swap = []
    for n in STAT_NAMES:
        swap.append(f"CASE WHEN first_a THEN a2b_{n} ELSE b2a_{n} END AS src2dst_{n}")
        swap.append(f"CASE WHEN first_a THEN b2a_{n} ELSE a2b_{n} END AS dst2src_{n}")
    bi_extra = [f"bidirectional_{n}" for n in STAT_NAMES[5:]]
    return assigned() + f""",
pw AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY {_KEY} ORDER BY ts_ms, packet_id) AS piat_bi,
              ts_ms - lag(ts_ms) OVER (PARTITION BY {_KEY}, a_sends ORDER BY ts_ms, packet_id) AS piat_dir FROM pf),
g AS (SELECT arg_min(src_ip, (ts_ms, packet_id)) AS src_ip, arg_min(dst_ip, (ts_ms, packet_id)) AS dst_ip,
             arg_min(src_port, (ts_ms, packet_id)) AS src_port, arg_min(dst_port, (ts_ms, packet_id)) AS dst_port,
             arg_min(a_sends, (ts_ms, packet_id)) AS first_a, protocol, max(expiration_id) AS expiration_id,
             {_dir("bidirectional", "TRUE")}, {_dir("a2b", "a_sends")}, {_dir("b2a", "NOT a_sends")}
      FROM pw GROUP BY {_KEY})
SELECT src_ip, dst_ip, src_port, dst_port, protocol, bidirectional_first_seen_ms, bidirectional_last_seen_ms,
       bidirectional_duration_ms, bidirectional_packets, bidirectional_bytes, expiration_id,
       {", ".join(swap)}, {", ".join(bi_extra)}
FROM g"""

F1_NULLS = F1_PACKETS.replace("f1_packets AS (", "f1_raw AS (") + """,
f1_packets AS (SELECT packet_id, CASE WHEN packet_id % 50 <> 7 THEN ts_ms END AS ts_ms, src_ip, dst_ip,
                      CASE WHEN packet_id % 5 <> 0 THEN src_port END AS src_port,
                      CASE WHEN packet_id % 5 <> 0 THEN dst_port END AS dst_port,
                      CASE WHEN packet_id % 5 = 0 THEN 1 ELSE protocol END AS protocol, bytes FROM f1_raw)"""
