"""Query key -> DuckDB SQL."""
from . import cleaning, learning as L, matching as M, metering as MT, odd_inputs, pipeline, reports

ORACLES = {
    "match_flows": M.match_flows(),
    "match_flows_1min": M.match_flows_1min(),
    "match_flows_large": M.match_flows_large(),
    **cleaning.ORACLES,
    **reports.ORACLES,
    **pipeline.ORACLES,
    **odd_inputs.ORACLES,
    "meter_flows": MT.meter_flows(),
    # the stream must give exactly the batch result
    "meter_flows_nulls": MT.meter_flows("", MT.F1_NULLS),
    "meter_flows_stream": MT.meter_flows(),
    "meter_expiration": MT.meter_expiration(),
    "meter_flows_by_capture": MT.meter_flows("capture", MT.F1_CAPTURES),
    "flow_stats": MT.flow_stats(),
    "flow_stats_stream": MT.flow_stats(),
    # the stream must give exactly the batch result
    "label_stream": L.label_stream(),
    "label_majority": L.label_majority(),
    "train_test_split": L.TRAIN_TEST_SPLIT,
    "classification_metrics": L.CLASSIFICATION_METRICS,
    "feature_vectors": L.FEATURE_VECTORS,
    "explore": L.explore(reports.ORACLES),
}
