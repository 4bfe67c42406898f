"""Oracles of the queries on infinities, repeated headers and null packets: the reports' SQL on other sources."""
from . import metering as MT
from . import reports as R

_RATE = "CASE l_partkey % 50 WHEN 1 THEN {pos} WHEN 2 THEN {neg} WHEN 3 THEN NULL ELSE l_extendedprice END"
_DECIDES = "CASE l_partkey % 50 WHEN 4 THEN {pos} ELSE ascii(l_returnflag) * 1000 + l_quantity END"


def _extremes(pos: str, neg: str) -> str:
    return (f"WITH f5_features AS (SELECT l_returnflag AS label, {_RATE.format(pos=pos, neg=neg)} AS rate, "
            f"{_DECIDES.format(pos=pos)} AS decides FROM lineitem)")


_INF = _extremes("CAST('inf' AS DOUBLE)", "CAST('-inf' AS DOUBLE)") + """,
long AS (UNPIVOT f5_features ON rate, decides INTO NAME feature VALUE value)
"""
_PORTS = """WITH f AS (SELECT event_type AS label, CAST(user_id % 1000 AS DOUBLE) AS a,
                  CASE WHEN event_id % 9 <> 4 THEN CAST(event_id % 97 AS DOUBLE) END AS b FROM events),
long AS (SELECT label, 'Port' AS feature, a AS value FROM f UNION ALL SELECT label, 'Port.1', b FROM f WHERE b IS NOT NULL)
"""


def _on(source: str, sql: str, was: str = R.LONG) -> str:
    if not sql.startswith(was):
        raise ValueError("the report's SQL does not begin with its source")
    return source + sql[len(was):]


def _knn() -> str:
    missing = _extremes("NULL", "NULL")
    return missing + R._knn()[len(R.W5):].replace(f"ON {', '.join(R.FEATS)} INTO", "ON rate, decides INTO")


F1_STREAM_NULLS = MT.F1_NULLS.replace(" ELSE protocol END AS protocol, bytes FROM", (
    " ELSE protocol END AS protocol, CASE WHEN packet_id % 7 <> 3 THEN bytes END AS bytes FROM"))

ORACLES = {
    "describe_features_inf": """SELECT feature, count, min, q25, q50, q75, max FROM (
""" + _INF + """SELECT feature, count(*) AS count, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM long GROUP BY feature)""",
    "boxplot_stats_inf": "SELECT feature, n, q1, median, q3, n_outliers FROM (" + _on(_INF, R.ORACLES["boxplot_stats"]) + ")",
    "mutual_information_knn_inf": _knn(),
    "repeated_header_nulls": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 4) AS b FROM events)
SELECT 'Flow ID' AS column_name, CAST(0 AS DOUBLE) AS null_pct UNION ALL SELECT 'Port', 0 UNION ALL SELECT 'Label', 0
UNION ALL SELECT 'Port.1', round(CAST(b * 100.0 / n AS DOUBLE), 6) FROM n""",
    "repeated_header_profile": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 9 <> 4) AS b FROM events)
SELECT 'Flow ID' AS column_name, 'string' AS dtype, n AS non_null, n AS n_rows FROM n UNION ALL SELECT 'Port', 'double', n, n FROM n
UNION ALL SELECT 'Port.1', 'double', b, n FROM n UNION ALL SELECT 'Label', 'string', n, n FROM n""",
    "repeated_header_describe": _on(_PORTS, R.ORACLES["describe_features"]),
    "repeated_header_histogram": _on(_PORTS, R._hist(4, False, False)),
    "repeated_header_boxplot": _on(_PORTS, R.ORACLES["boxplot_stats"]),
    "repeated_header_information": _on(_PORTS, R.MI_BINNED.replace("least(25,", "least(8,").replace("* 25 /", "* 8 /").replace("/ 25", "/ 8"),
                                       R.LONG_L) + " ORDER BY mi DESC, feature LIMIT 1",
    "meter_flows_stream_nulls": MT.meter_flows("", F1_STREAM_NULLS),
}
