"""Query key -> callable(spark, sf_dir)."""
from . import learning_queries as LQ
from . import queries as Q

QUERIES = {
    "match_flows": Q.q_match_flows,
    "match_flows_large": Q.q_match_flows_large,
    "csv_scan_labels": Q.q_csv_scan_labels,
    "labels_concat": Q.q_labels_concat,
    "clean_columns": Q.q_clean_columns,
    "replace_infinities": Q.q_replace_infinities,
    "dedup_columns": Q.q_dedup_columns,
    "dedup_rows": Q.q_dedup_rows,
    "label_cleanup": Q.q_label_cleanup,
    "parse_dayfirst": Q.q_parse_dayfirst,
    "epoch_ms": Q.q_epoch_ms,
    "rename_columns": Q.q_rename_columns,
    "repair_12h_clock": Q.q_repair_12h_clock,
    "shift_hours": Q.q_shift_hours,
    "tag_dataset": Q.q_tag_dataset,
    "flow_keys": Q.q_flow_keys,
    "to_numeric": Q.q_to_numeric,
    "drop_null_rows": Q.q_drop_null_rows,
    "log1p_feature": Q.q_log1p_feature,
    "from_epoch_ms": Q.q_from_epoch_ms,
    "prepare_labels": Q.q_prepare_labels,
    "build_dataset": Q.q_build_dataset,
    "label_distribution": Q.q_label_distribution,
    "label_distribution_nulls": Q.q_label_distribution_nulls,
    "distinct_keys": Q.q_distinct_keys,
    "key_ambiguity": Q.q_key_ambiguity,
    "conflict_detail": Q.q_conflict_detail,
    "flow_label_ratio": Q.q_flow_label_ratio,
    "label_counts_by_stage": Q.q_label_counts_by_stage,
    "duration_histogram": Q.q_duration_histogram,
    "duration_range": Q.q_duration_range,
    "null_percentage": Q.q_null_percentage,
    "duplicate_row_count": Q.q_duplicate_row_count,
    "match_rate": Q.q_match_rate,
    "table_profile": Q.q_table_profile,
    "describe_features": Q.q_describe_features,
    "feature_dispersion": Q.q_feature_dispersion,
    "correlation_matrix": Q.q_correlation_matrix,
    "high_correlation_pairs": Q.q_high_correlation_pairs,
    "histogram": Q.q_histogram,
    "histogram_by_label": Q.q_histogram_by_label,
    "boxplot_stats": Q.q_boxplot_stats,
    "boxplot_by_label": Q.q_boxplot_by_label,
    "unpivot_features": Q.q_unpivot_features,
    "select_features": Q.q_select_features,
    "label_encode": Q.q_label_encode,
    "mutual_information_binned": Q.q_mutual_information_binned,
    "top_features": Q.q_top_features,
    "preview_rows": Q.q_preview_rows,
    "sample_fixed_n": Q.q_sample_fixed_n,
    "split_key_counts": Q.q_split_key_counts,
    "semi_join_keys": Q.q_semi_join_keys,
    "match_unique_forward": Q.q_match_unique_forward,
    "match_unique_reverse": Q.q_match_unique_reverse,
    "match_duplicate_consensus": Q.q_match_duplicate_consensus,
    "match_duplicate_reverse": Q.q_match_duplicate_reverse,
    "tolerance_sweep": Q.q_tolerance_sweep,
    "meter_flows": Q.q_meter_flows,
    "meter_flows_nulls": Q.q_meter_flows_nulls,
    "match_flows_1min": Q.q_match_flows_1min,
    "meter_expiration": Q.q_meter_expiration,
    "flow_stats": Q.q_flow_stats,
    "parquet_scan_pruned": Q.q_parquet_scan_pruned,
    "rows_per_file": Q.q_rows_per_file,
    "merge_scenarios": Q.q_merge_scenarios,
    "merge_datasets": Q.q_merge_datasets,
    "dataset_pipeline": Q.q_dataset_pipeline,
    "run_dataset": Q.q_run_dataset,
    "capture_report": Q.q_capture_report,
    "capture_states": Q.q_capture_states,
    "mutual_information_knn": Q.q_mutual_information_knn,
    "mutual_information_knn_all": Q.q_mutual_information_knn_all,
    "flow_label_report": Q.q_flow_label_report,
    "build_dataset_report": Q.q_build_dataset_report,
    "meter_flows_stream": Q.q_meter_flows_stream,
    "meter_flows_by_capture": Q.q_meter_flows_by_capture,
    "sample_column_values": Q.q_sample_column_values,
    "describe_features_inf": Q.q_describe_features_inf,
    "boxplot_stats_inf": Q.q_boxplot_stats_inf,
    "mutual_information_knn_inf": Q.q_mutual_information_knn_inf,
    "repeated_header_nulls": Q.q_repeated_header_nulls,
    "repeated_header_profile": Q.q_repeated_header_profile,
    "repeated_header_describe": Q.q_repeated_header_describe,
    "repeated_header_histogram": Q.q_repeated_header_histogram,
    "repeated_header_boxplot": Q.q_repeated_header_boxplot,
    "repeated_header_information": Q.q_repeated_header_information,
    "meter_flows_stream_nulls": Q.q_meter_flows_stream_nulls,
    "flow_stats_stream": Q.q_flow_stats_stream,
    **LQ.QUERIES,
}
