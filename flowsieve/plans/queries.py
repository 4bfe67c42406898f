"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads whole driver tables (through the stand-in builders) so its work
grows with the data.
"""
from __future__ import annotations

import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.keys import with_flow_keys
from ..functions.roles import split_features
from ..functions.timecols import epoch_ms, from_epoch_ms
from ..operators import matching as M
from ..operators import metering as MT
from ..operators import profile as P
from ..operators import quality as QA
from ..operators import sampling as SM
from ..operators.mutual_info import mutual_information_knn
from ..session import shared_dir as _shared_dir
from ..sources import files as IO
from ..sources.captures import capture_report, capture_states
from ..sources.catalog import paths_of
from ..streaming.metering import run_stream_to_table
from . import label_files as LF
from . import standins as S
from .pipeline import build_and_save, build_dataset, dataset_pipeline, run_dataset
from .prepare_labels import prepare_labels


def q_match_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: F2 flows labelled in both directions, 24 h tolerance."""
    return M.match_flows(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir), S.F2_TOLERANCE_MS)


def q_match_flows_1min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 flows labelled in both directions at the pipeline's own tolerance, one minute."""
    return M.match_flows(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir), 60_000)


def q_match_flows_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 (lineitem) forward matching, 180-day tolerance."""
    return M.match_flows(S.f3_flows(spark, sf_dir), S.f3_labels(spark, sf_dir), S.F3_TOLERANCE_MS,
                         directions="forward", flow_ts="ts_ms")


# --- label files and cleaning (S1, S2, C1-C11, C14, C15, P1) -------------------------


def _label_paths(spark, sf_dir):
    p = LF.write_label_files(spark, sf_dir)
    return [p["utf8"], p["latin1"]]


def q_csv_scan_labels(spark, sf_dir):
    """The Latin-1 file read as strings with raw (unstripped) names."""
    return IO.read_label_csv(spark, LF.write_label_files(spark, sf_dir, split=False)["latin1"])


def q_labels_concat(spark, sf_dir):
    """Both files of a scenario, names stripped per file, union by name."""
    return IO.read_label_csvs(spark, _label_paths(spark, sf_dir))


def q_clean_columns(spark, sf_dir):
    """Strip blanks around names (the UTF-8 file)."""
    return C.clean_column_names(IO.read_label_csv(spark, LF.write_label_files(spark, sf_dir, split=False)["utf8"]))


def q_dedup_columns(spark, sf_dir):
    """After stripping, ' Label' and 'Label' collide; the first is kept."""
    raw = IO.read_label_csv(spark, LF.write_label_files(spark, sf_dir, split=False)["latin1"])
    return C.remove_duplicated_cols(C.clean_column_names(raw))


def q_dedup_rows(spark, sf_dir):
    """Distinct rows of the concatenated label files."""
    return C.remove_duplicated_rows(IO.read_label_csvs(spark, _label_paths(spark, sf_dir)))


def q_label_cleanup(spark, sf_dir):
    """C1 -> C2 -> C3 -> C4 on the concatenated files."""
    return C.dataset_cleanup(IO.read_label_csvs(spark, _label_paths(spark, sf_dir), strip_names=False))


def q_rename_columns(spark, sf_dir):
    """Standard five-tuple and label names."""
    return C.rename_columns(IO.read_label_csvs(spark, _label_paths(spark, sf_dir)))


def q_to_numeric(spark, sf_dir):
    """C14: text to numbers, invalid text -> null."""
    df = IO.read_label_csvs(spark, _label_paths(spark, sf_dir))
    return df.select(F.col("Flow ID").alias("flow_id_text"),
                     C.to_numeric("Source Port", "bigint").alias("src_port_num"),
                     C.to_numeric("Timestamp", "double").alias("timestamp_num"),
                     C.to_numeric("Flow ID", "double").alias("flow_id_num"))


def q_drop_null_rows(spark, sf_dir):
    """Rows without a time or a label are dropped."""
    return C.drop_null_rows(IO.read_label_csvs(spark, _label_paths(spark, sf_dir)), ["Timestamp", "Label"])


def q_prepare_labels(spark, sf_dir):
    """The whole label preparation over both files."""
    return prepare_labels(spark, _label_paths(spark, sf_dir))


def q_parse_dayfirst(spark, sf_dir):
    """Parse day-first 12-hour text (no repair)."""
    raw = S.f4_raw(spark, sf_dir)
    return raw.select("event_id", "raw_ts", C.parse_dayfirst("raw_ts").alias("parsed"))


def q_repair_12h_clock(spark, sf_dir):
    """Parse then move hours 1..5 to the afternoon; must restore the true minute of business hours."""
    raw = S.f4_raw(spark, sf_dir)
    rep = C.repair_12h_clock(C.parse_dayfirst("raw_ts"))
    return raw.select("event_id", rep.alias("repaired"), "true_minute",
                      F.when(S.business_hours("true_minute"), rep == F.col("true_minute")).alias("restored"))


def q_shift_hours(spark, sf_dir):
    """+3 h on the repaired time."""
    raw = S.f4_raw(spark, sf_dir)
    df = raw.select("event_id", C.repair_12h_clock(C.parse_dayfirst("raw_ts")).alias("Timestamp"))
    return C.shift_hours(df, "Timestamp", 3)


def q_epoch_ms(spark, sf_dir):
    """Epoch milliseconds of event times."""
    ev = S.table(spark, sf_dir, "events")
    return ev.select("event_id", epoch_ms(ev, "ts").alias("ts_ms"))


def q_from_epoch_ms(spark, sf_dir):
    """C20: epoch milliseconds back to a wall-clock timestamp."""
    lab = S.f2_all_labels(spark, sf_dir)
    return lab.select("label_id", "ts_ms", from_epoch_ms("ts_ms").alias("ts"))


def q_tag_dataset(spark, sf_dir):
    """C11: provenance column."""
    return C.tag_dataset(S.f2_all_labels(spark, sf_dir), "events_flows")


def q_flow_keys(spark, sf_dir):
    """Forward and reverse keys of packets."""
    return with_flow_keys(S.f1_packets(spark, sf_dir)).select("packet_id", "flow_key", "flow_key_rev")


def q_replace_infinities(spark, sf_dir):
    """+-inf and NaN become null in floating columns."""
    li = S.table(spark, sf_dir, "lineitem")
    df = li.select("l_orderkey", "l_linenumber",
                   F.when(F.col("l_discount") == 0, F.lit(float("inf")))
                    .otherwise(F.col("l_extendedprice") / F.col("l_discount")).alias("price_per_discount"),
                   F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
                   F.when(F.col("l_quantity") < 2, F.lit(float("-inf")))
                    .otherwise(F.col("l_quantity")).alias("qty"))
    return C.replace_infinities(df)


def q_log1p_feature(spark, sf_dir):
    """ln(1 + x) of a feature."""
    f5 = S.f5_features(spark, sf_dir)
    return f5.select("p", "q", F.round(C.log1p("p"), 6).alias("log1p_p"),
                     F.round(C.log1p("q"), 6).alias("log1p_q"))


# --- reports, profiling, ordering (A1-A22, C22, C26, O4-O6) ------------------------------


def _matched(spark, sf_dir):
    return q_match_flows(spark, sf_dir)


def q_build_dataset(spark, sf_dir):
    return build_dataset(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir), "events_flows",
                         S.F2_TOLERANCE_MS)


def q_build_dataset_report(spark, sf_dir):
    """J7 as a run: the dataset is saved, the answer is the match rate of its flows."""
    return build_and_save(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir), "events_flows", S.F2_TOLERANCE_MS,
                          f"{_shared_dir(spark)}/built-{_uuid.uuid4().hex}")


def q_flow_label_report(spark, sf_dir):
    """Rows and columns of flows and labels, and the label distribution."""
    return QA.flow_label_report(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir))


def q_label_distribution(spark, sf_dir):
    return QA.value_counts(S.f5_features(spark, sf_dir), "label")


def q_label_distribution_nulls(spark, sf_dir):
    return QA.value_counts(_matched(spark, sf_dir), "label", dropna=False)


def q_distinct_keys(spark, sf_dir):
    return QA.distinct_count(S.f2_all_labels(spark, sf_dir), "flow_key")


def q_key_ambiguity(spark, sf_dir):
    return QA.key_ambiguity(S.f2_all_labels(spark, sf_dir))


def q_conflict_detail(spark, sf_dir):
    return QA.conflict_detail(S.f2_all_labels(spark, sf_dir))


def q_flow_label_ratio(spark, sf_dir):
    return QA.flow_label_ratio(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir))


def q_label_counts_by_stage(spark, sf_dir):
    return QA.label_counts_by_stage({"labels": S.f2_labels(spark, sf_dir),
                                     "processed": q_build_dataset(spark, sf_dir)})


def q_duration_histogram(spark, sf_dir):
    return QA.duration_histogram(spark, S.f6_durations(spark, sf_dir), "flow_duration_us")


def q_duration_range(spark, sf_dir):
    return QA.duration_range(S.f6_durations(spark, sf_dir), "flow_duration_us")


def q_null_percentage(spark, sf_dir):
    return QA.null_percentage(S.f5_features(spark, sf_dir))


def q_duplicate_row_count(spark, sf_dir):
    return QA.duplicate_row_count(IO.read_label_csvs(spark, _label_paths(spark, sf_dir)))


def q_match_rate(spark, sf_dir):
    return QA.match_rate(_matched(spark, sf_dir))


def q_table_profile(spark, sf_dir):
    return QA.table_profile(S.table(spark, sf_dir, "events"))


def q_describe_features(spark, sf_dir):
    return P.describe(S.f5_features(spark, sf_dir))


EXTREMES = ["rate", "decides"]


def q_describe_features_inf(spark, sf_dir):
    """A10 with infinities, refined far below the row count."""
    out = P.describe(S.f5_extremes(spark, sf_dir), EXTREMES, max_exact=500)
    return out.select("feature", "count", "min", "q25", "q50", "q75", "max")


def q_boxplot_stats_inf(spark, sf_dir):
    """A18 with infinities: infinite values are outliers."""
    return P.boxplot_stats(S.f5_extremes(spark, sf_dir), EXTREMES, max_exact=500).select(
        "feature", "n", "q1", "median", "q3", "n_outliers")


def q_mutual_information_knn_inf(spark, sf_dir):
    """A16a with infinite and NaN values, which are missing."""
    return mutual_information_knn(S.f5_extremes(spark, sf_dir), ["rate", "decides"], id_cols=LINEITEM_KEY, jitter=False)


def _repeated_header(spark, sf_dir):
    """The label file as scanned, with a header that comes twice (name and name.1) and numeric ports."""
    raw = IO.read_label_csv(spark, LF.write_repeated_header(spark, sf_dir))
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c) if c.startswith("Port") else F.col(f"`{c}`") for c in raw.columns])


def q_repeated_header_nulls(spark, sf_dir):
    """A8 on a file with a repeated header."""
    return QA.null_percentage(_repeated_header(spark, sf_dir))


def q_repeated_header_profile(spark, sf_dir):
    """A19 on a file with a repeated header."""
    return QA.table_profile(_repeated_header(spark, sf_dir))


def q_repeated_header_describe(spark, sf_dir):
    """A10, A22 on a file with a repeated header."""
    return P.describe(_repeated_header(spark, sf_dir), ["Port", "Port.1"])


def q_repeated_header_histogram(spark, sf_dir):
    """A17 on a file with a repeated header."""
    return P.histogram(_repeated_header(spark, sf_dir), ["Port", "Port.1"], bins=4)


def q_repeated_header_boxplot(spark, sf_dir):
    """A18 on a file with a repeated header."""
    return P.boxplot_stats(_repeated_header(spark, sf_dir), ["Port", "Port.1"])


def q_repeated_header_information(spark, sf_dir):
    """A16b, O5 on a file with a repeated header."""
    df = _repeated_header(spark, sf_dir)
    return SM.top_features(P.mutual_information_binned(df, ["Port", "Port.1"], label="Label", bins=8), k=1)


def q_feature_dispersion(spark, sf_dir):
    return P.dispersion(S.f5_features(spark, sf_dir))


def q_correlation_matrix(spark, sf_dir):
    return P.correlation_matrix(S.f5_features(spark, sf_dir))


def q_high_correlation_pairs(spark, sf_dir):
    return P.high_correlation_pairs(S.f5_features(spark, sf_dir))


def q_histogram(spark, sf_dir):
    return P.histogram(S.f5_features(spark, sf_dir), bins=25)


def q_histogram_by_label(spark, sf_dir):
    return P.histogram(S.f5_features(spark, sf_dir), bins=10, log=True, by_label=True)


def q_boxplot_stats(spark, sf_dir):
    return P.boxplot_stats(S.f5_features(spark, sf_dir))


def q_boxplot_by_label(spark, sf_dir):
    return P.boxplot_stats(S.f5_features(spark, sf_dir), by_label=True)


def q_unpivot_features(spark, sf_dir):
    return P.unpivot_features(S.f5_features(spark, sf_dir), ids=["label"])


def q_select_features(spark, sf_dir):
    df = S.f5_features(spark, sf_dir)
    numeric, categorical = split_features(df)
    return df.select(*numeric, *categorical)


def q_label_encode(spark, sf_dir):
    return P.label_encode(S.f5_features(spark, sf_dir)).select("label", "label_code", "p")


def q_mutual_information_binned(spark, sf_dir):
    return P.mutual_information_binned(S.f5_features(spark, sf_dir))


def q_top_features(spark, sf_dir):
    return SM.top_features(q_mutual_information_binned(spark, sf_dir), k=15)


def q_preview_rows(spark, sf_dir):
    return SM.preview_rows(S.f2_all_flows(spark, sf_dir), 10, order_by=("flow_id",))


# (l_orderkey, l_linenumber) repeats in the driver data; with part and supplier it is unique.
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def q_sample_fixed_n(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    li = li.select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_partkey % 10 <> 3 THEN l_partkey END").alias("l_partkey"),
                   "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return SM.sample_fixed_n(li, 3000, 42, LINEITEM_KEY)  # below the row count, with null ids


def q_split_key_counts(spark, sf_dir):
    """Label rows tagged with key multiplicity."""
    return M.split_by_key_count(S.f2_all_labels(spark, sf_dir)).select(
        "label_id", "flow_key", "key_count", "key_class")


def q_semi_join_keys(spark, sf_dir):
    """Flows whose key occurs among the label keys."""
    return M.semi_join_keys(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir))


def q_tolerance_sweep(spark, sf_dir):
    return M.tolerance_sweep(S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir))


def _pass(spark, sf_dir, p):
    m = _matched(spark, sf_dir)
    return m.where(F.col("match_pass") == p).select("flow_id", "label")


def q_match_unique_forward(spark, sf_dir):
    """Flows labelled by unique keys in the forward direction."""
    return _pass(spark, sf_dir, "uf")


def q_match_unique_reverse(spark, sf_dir):
    """Unique keys, reverse direction (flows the forward pass left unlabelled)."""
    return _pass(spark, sf_dir, "ur")


def q_match_duplicate_consensus(spark, sf_dir):
    """Repeated keys, all forward candidates in tolerance agree."""
    return _pass(spark, sf_dir, "df")


def q_match_duplicate_reverse(spark, sf_dir):
    """Repeated keys, reverse direction, unanimous."""
    return _pass(spark, sf_dir, "dr")


# --- flow metering (M1-M3, M5) ------------------------------------------------------------


def q_meter_flows(spark, sf_dir):
    """M1: packets of F1 grouped into flows, idle 6 h / active 24 h."""
    return MT.meter_flows(S.f1_packets(spark, sf_dir), S.F1_IDLE_MS, S.F1_ACTIVE_MS)


def q_meter_flows_nulls(spark, sf_dir):
    """M1 on F1 packets of which some have no ports (ICMP) and some no time."""
    return MT.meter_flows(S.f1_nulls(spark, sf_dir), S.F1_IDLE_MS, S.F1_ACTIVE_MS)


def q_meter_expiration(spark, sf_dir):
    """M2: flows per expiry reason (0 idle, 1 active)."""
    return (q_meter_flows(spark, sf_dir).groupBy("expiration_id")
            .agg(F.count(F.lit(1)).alias("n")))


def q_flow_stats(spark, sf_dir):
    """M3/M5: per-direction statistics, byte column as packet size."""
    return MT.meter_flows(S.f1_packets(spark, sf_dir), S.F1_IDLE_MS, S.F1_ACTIVE_MS,
                          statistics=True, byte_col="bytes")


# --- sources and the pipeline (S3, S5-S7, P2) ----------------------------------------------


DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def q_parquet_scan_pruned(spark, sf_dir):
    """S3: a column subset; only those columns reach the scan (ReadSchema)."""
    return IO.load_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_returnflag"])


def q_rows_per_file(spark, sf_dir):
    """Row count per driver file."""
    frames = [IO.rows_per_file(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in DRIVER_TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def q_merge_scenarios(spark, sf_dir):
    """Scenario tables written separately (one lacks a column), merged by name."""
    root = f"{_shared_dir(spark)}/scenarios-{_uuid.uuid4().hex}"
    fl, monday = S.f7_flows(spark, sf_dir), F.col("scenario") == "monday"
    IO.save_parquet(fl.where(~monday), root, partition_by=["scenario"])
    IO.save_parquet(fl.where(monday).drop("scenario", "flow_key_rev"), f"{root}/scenario=monday")
    return IO.merge_scenarios(spark, root)


def q_merge_datasets(spark, sf_dir):
    """Two datasets unioned with their names."""
    return IO.merge_datasets({"events_flows": S.f2_flows(spark, sf_dir),
                              "lineitem_flows": S.f3_flows(spark, sf_dir).select(
                                  F.col("l_orderkey").alias("flow_id"), "flow_key",
                                  F.col("ts_ms").alias("bidirectional_first_seen_ms"))})


def q_dataset_pipeline(spark, sf_dir):
    """Five scenarios matched in one plan, written partitioned, merged back."""
    return dataset_pipeline(S.f7_flows(spark, sf_dir), S.f7_labels(spark, sf_dir), "events_flows",
                            S.F2_TOLERANCE_MS)


def q_run_dataset(spark, sf_dir):
    """P2 from raw files: label text prepared, captures metered, matched at one minute, saved and merged."""
    return run_dataset(spark, LF.write_dataset(spark, sf_dir), "events_dataset", S.f1_packets(spark, sf_dir).schema,
                       idle_ms=S.F1_IDLE_MS, active_ms=S.F1_ACTIVE_MS)


def q_capture_report(spark, sf_dir):
    """Packets read per scenario (files of a scenario vary with the writer), and unreadable captures."""
    catalog, schema = LF.write_dataset(spark, sf_dir), S.f1_packets(spark, sf_dir).schema
    frames = [capture_report(spark, paths_of(catalog, "events_dataset", sc, "captures"), schema).select(
        F.lit(sc).alias("scenario"), "packets", "files_without_packets") for sc in catalog["events_dataset"]]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def q_capture_states(spark, sf_dir):
    """Empty, unreadable and broken captures told apart, per scenario (files of good captures vary with the writer)."""
    catalog, schema = LF.write_odd_captures(spark, sf_dir), S.f1_packets(spark, sf_dir).schema
    out = None
    for sc in catalog["events_dataset"]:
        s = capture_states(spark, paths_of(catalog, "events_dataset", sc, "captures"), schema)
        g = s.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("packets_listed").alias("packets_listed"),
                                   F.sum("packets_read").alias("packets_read"))
        g = g.select(F.lit(sc).alias("scenario"), "state", F.when(F.col("state") != "ok", F.col("n")).alias("files"),
                     "packets_listed", "packets_read")
        out = g if out is None else out.union(g)
    return out


KNN_FEATURES = ["q", "p", "d", "t", "net", "d_null", "const"]


def _keyed_features(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    return li.select(*LINEITEM_KEY, F.col("l_quantity").alias("q"),
                   F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"),
                   F.col("l_tax").alias("t"),
                   (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                   F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("d_null"),
                   F.lit(1.0).alias("const"), F.col("l_returnflag").alias("label"))


def q_mutual_information_knn(spark, sf_dir):
    """O6 then A16a: k-NN mutual information on a seeded sample of 100,000 rows, the sampling being the feature."""
    return mutual_information_knn(_keyed_features(spark, sf_dir), KNN_FEATURES, sample_rows=100_000, seed=42,
                                  id_cols=LINEITEM_KEY)


def q_mutual_information_knn_all(spark, sf_dir):
    """A16a over all rows, without noise (so that SQL can state it)."""
    return mutual_information_knn(_keyed_features(spark, sf_dir), KNN_FEATURES, id_cols=LINEITEM_KEY, jitter=False)


def q_meter_flows_stream(spark, sf_dir):
    """M4: F1 packets replayed as a file stream and metered with state and timeouts."""
    return run_stream_to_table(spark, S.f1_packets(spark, sf_dir), S.F1_IDLE_MS, S.F1_ACTIVE_MS)


def q_meter_flows_stream_nulls(spark, sf_dir):
    """M4 on F1 packets of which some have no ports, some no time and some no size."""
    return run_stream_to_table(spark, S.f1_stream_nulls(spark, sf_dir), S.F1_IDLE_MS, S.F1_ACTIVE_MS)


def q_flow_stats_stream(spark, sf_dir):
    """M3 + M4: the replayed stream with per-direction statistics."""
    return run_stream_to_table(spark, S.f1_packets(spark, sf_dir), S.F1_IDLE_MS, S.F1_ACTIVE_MS, statistics=True)


def q_meter_flows_by_capture(spark, sf_dir):
    """M1 + S9: several captures in one table, the capture is part of every key."""
    return MT.meter_flows(S.f1_captures(spark, sf_dir), S.F1_IDLE_MS, S.F1_ACTIVE_MS, scope=["capture"])


def q_sample_column_values(spark, sf_dir):
    """Ten values of one column, reproducible (row key + seed hash)."""
    li = S.table(spark, sf_dir, "lineitem")
    return SM.sample_fixed_n(li.select(*LINEITEM_KEY, "l_extendedprice"), 10, 7, LINEITEM_KEY) \
             .select("l_extendedprice")
