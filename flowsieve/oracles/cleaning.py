"""Oracles for label files, cleaning and time repair."""
from .standins import CLOCK_TEXT, F2, F4_RAW, F5_FEATURES, F1_PACKETS

_NAMES = ("Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port",
          "Protocol", "Timestamp", "Label")
_RAW = ['"Flow ID"'] + [f'" {n}"' for n in _NAMES[1:]]
_STRIPPED = [f'"{n}"' for n in _NAMES]
_NULL8 = ", ".join(["CAST(NULL AS VARCHAR)"] * 8)

LABEL_FILES = f"""
lrows AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS "Flow ID",
         '10.0.0.' || user_id AS " Source IP", CAST(1024 + user_id AS VARCHAR) AS " Source Port",
         '192.168.0.' || (event_id % 16) AS " Destination IP", '80' AS " Destination Port",
         '6' AS " Protocol", {CLOCK_TEXT} AS " Timestamp",
         event_type AS " Label"
  FROM events),
lrows2 AS (SELECT * FROM lrows UNION ALL SELECT * FROM lrows WHERE event_id % 10 IN (0, 1)),
utf8 AS (SELECT {", ".join(_RAW)} FROM lrows2 WHERE event_id % 2 = 0
         UNION ALL SELECT {_NULL8}),
latin1 AS (SELECT {", ".join(_RAW[:7])}, 'Web Attack ' || chr(150) || ' ' || " Label" AS " Label",
                  'dup' AS "Label" FROM lrows2 WHERE event_id % 2 = 1
           UNION ALL SELECT {_NULL8}, CAST(NULL AS VARCHAR)),
cat AS (SELECT {", ".join(f"{r} AS {s}" for r, s in zip(_RAW, _STRIPPED))} FROM utf8
        UNION ALL
        SELECT {", ".join(f"{r} AS {s}" for r, s in zip(_RAW, _STRIPPED))} FROM latin1)"""

W = "WITH " + LABEL_FILES + "\n"
#: Both files with all rows.
W_ALL = W.replace(" WHERE event_id % 2 = 0", "").replace(" WHERE event_id % 2 = 1", "")
STRIP_SEL = ", ".join(f"{r} AS {s}" for r, s in zip(_RAW, _STRIPPED))
RENAMED = ('"Flow ID", "Source IP" AS src_ip, "Source Port" AS src_port, "Destination IP" AS dst_ip, '
           '"Destination Port" AS dst_port, "Protocol" AS protocol, "Timestamp", "Label" AS label')
PARSE = ("coalesce(try_strptime({c}, '%d/%m/%Y %H:%M:%S'), try_strptime({c}, '%d/%m/%Y %H:%M'))")
REPAIR = "CASE WHEN hour({c}) BETWEEN 1 AND 5 THEN {c} + INTERVAL 12 HOUR ELSE {c} END"

ORACLES = {
    "csv_scan_labels": W_ALL + "SELECT * FROM latin1",
    "labels_concat": W + "SELECT * FROM cat",
    "clean_columns": W_ALL + f"SELECT {STRIP_SEL} FROM utf8",
    "dedup_columns": W_ALL + f"SELECT {STRIP_SEL} FROM latin1",
    "dedup_rows": W + "SELECT DISTINCT * FROM cat",
    "label_cleanup": W + "SELECT DISTINCT * FROM cat",
    "rename_columns": W + f"SELECT {RENAMED} FROM cat",
    "to_numeric": W + """SELECT "Flow ID" AS flow_id_text, TRY_CAST("Source Port" AS BIGINT) AS src_port_num,
       TRY_CAST("Timestamp" AS DOUBLE) AS timestamp_num, TRY_CAST("Flow ID" AS DOUBLE) AS flow_id_num FROM cat""",
    "drop_null_rows": W + 'SELECT * FROM cat WHERE "Timestamp" IS NOT NULL AND "Label" IS NOT NULL',
    "prepare_labels": W + f""",
d AS (SELECT DISTINCT * FROM cat),
r AS (SELECT {RENAMED.replace('"Timestamp", ', '')}, {PARSE.format(c='"Timestamp"')} AS t0 FROM d),
r2 AS (SELECT * EXCLUDE (t0), ({REPAIR.format(c='t0')}) + INTERVAL 3 HOUR AS "Timestamp" FROM r)
SELECT *, epoch_us("Timestamp") // 1000 AS ts_ms FROM r2""".replace("WITH \n", "WITH ").replace("\n,\nd AS", ",\nd AS"),
    "parse_dayfirst": "WITH " + F4_RAW + f"\nSELECT event_id, raw_ts, {PARSE.format(c='raw_ts')} AS parsed FROM f4_raw",
    "repair_12h_clock": "WITH " + F4_RAW + f""",
p AS (SELECT event_id, true_minute, {PARSE.format(c='raw_ts')} AS t0 FROM f4_raw)
SELECT event_id, {REPAIR.format(c='t0')} AS repaired, true_minute,
       CASE WHEN hour(true_minute) BETWEEN 8 AND 17 THEN ({REPAIR.format(c='t0')}) = true_minute END AS restored FROM p""",
    "shift_hours": "WITH " + F4_RAW + f""",
p AS (SELECT event_id, {PARSE.format(c='raw_ts')} AS t0 FROM f4_raw)
SELECT event_id, ({REPAIR.format(c='t0')}) + INTERVAL 3 HOUR AS "Timestamp" FROM p""",
    "epoch_ms": "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events",
    "from_epoch_ms": "WITH " + F2 + "\nSELECT label_id, ts_ms, make_timestamp(ts_ms * 1000) AS ts FROM f2_all_labels",
    "tag_dataset": "WITH " + F2 + "\nSELECT *, 'events_flows' AS dataset_name FROM f2_all_labels",
    "flow_keys": "WITH " + F1_PACKETS + """
SELECT packet_id,
       src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port || '|' || protocol AS flow_key,
       dst_ip || '|' || src_ip || '|' || dst_port || '|' || src_port || '|' || protocol AS flow_key_rev
FROM f1_packets""",
    "replace_infinities": """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS price_per_discount,
       CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax,
       CASE WHEN l_quantity < 2 THEN NULL ELSE l_quantity END AS qty
FROM lineitem""",
    "log1p_feature": "WITH " + F5_FEATURES + """
SELECT p, q, round(ln(1 + p), 6) AS log1p_p, round(ln(1 + q), 6) AS log1p_q FROM f5_features""",
}
