"""Stand-in inputs (fixtures F1-F7) as DuckDB common table expressions."""

F1_PACKETS = """
f1_packets AS (
  SELECT event_id AS packet_id, (epoch_us(ts) // 1000) AS ts_ms,
         CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || user_id ELSE '192.168.0.1' END AS src_ip,
         CASE WHEN event_id % 2 = 0 THEN '192.168.0.1' ELSE '10.0.0.' || user_id END AS dst_ip,
         CASE WHEN event_id % 2 = 0 THEN 1024 + user_id ELSE 80 END AS src_port,
         CASE WHEN event_id % 2 = 0 THEN 80 ELSE 1024 + user_id END AS dst_port,
         6 AS protocol, CAST(40 + event_id % 1460 AS BIGINT) AS bytes
  FROM events)"""

F2 = """
f2_base AS (
  SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms, event_type, '10.0.0.' || user_id AS a,
         '192.168.0.' || (event_id % 16) AS b, 1024 + user_id AS pa, 80 AS pb
  FROM events),
f2_all_flows AS (
  SELECT event_id AS flow_id, a AS src_ip, b AS dst_ip, pa AS src_port, pb AS dst_port, 6 AS protocol,
         ts_ms AS bidirectional_first_seen_ms,
         a || '|' || b || '|' || pa || '|' || pb || '|6' AS flow_key,
         b || '|' || a || '|' || pb || '|' || pa || '|6' AS flow_key_rev
  FROM f2_base),
f2_flows AS (SELECT * FROM f2_all_flows WHERE (flow_id // 16) % 2 = 0),
f2_all_labels AS (
  SELECT event_id AS label_id, ts_ms, event_type AS label,
         CASE WHEN event_id % 3 = 0 THEN b || '|' || a || '|' || pb || '|' || pa || '|6'
              ELSE a || '|' || b || '|' || pa || '|' || pb || '|6' END AS flow_key
  FROM f2_base),
f2_labels AS (SELECT * FROM f2_all_labels WHERE (label_id // 16) % 2 = 1)"""

F3 = """
f3_flows AS (
  SELECT *, l_orderkey || '|' || (l_suppkey % 2) AS flow_key, (epoch_us(l_shipdate) // 1000) AS ts_ms
  FROM lineitem WHERE l_linenumber % 2 = 1),
f3_labels AS (
  SELECT l_orderkey || '|' || (l_suppkey % 2) AS flow_key, (epoch_us(l_shipdate) // 1000) AS ts_ms,
         l_returnflag AS label
  FROM lineitem WHERE l_linenumber % 2 = 0)"""

CLOCK_TEXT = ("CASE WHEN hour(ts) BETWEEN 8 AND 17 THEN strftime(date_trunc('minute', ts), '%-d/%-m/%Y %-I:%M') "
              "ELSE strftime(date_trunc('minute', ts), '%-d/%-m/%Y %-H:%M') END")

F4_RAW = f"""
f4_raw AS (
  SELECT event_id, event_type AS label, date_trunc('minute', ts) AS true_minute,
         {CLOCK_TEXT} AS raw_ts
  FROM events)"""

F5_FEATURES = """
f5_features AS (
  SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t,
         l_extendedprice * (1 - l_discount) AS net, nullif(l_discount, 0) AS d_null,
         CAST(1.0 AS DOUBLE) AS const, l_returnflag AS label
  FROM lineitem)"""

F6_DURATIONS = """
f6_durations AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN -1
         ELSE (event_id % 13) * CAST(pow(10, event_id % 9) AS BIGINT) END AS flow_duration_us
  FROM events)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
