"""Dataset build (J7) and the multi-scenario pipeline (P2) as one plan.

The reference runs each scenario alone; here ``scenario`` is a column in every
key (matching is scoped by it), the processed table is written partitioned by
``dataset_name, scenario`` and read back as the merged dataset (S4, S5).
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import tag_dataset
from ..functions.keys import with_flow_keys
from ..operators.matching import match_flows
from ..operators.metering import meter_flows
from ..operators.quality import match_rate
from ..session import materialize, shared_dir
from ..sources.captures import read_captures
from ..sources.catalog import paths_of
from ..sources.files import save_parquet
from .prepare_labels import prepare_labels


def build_dataset(flows: DataFrame, labels: DataFrame, dataset_name: str, tolerance_ms: int,
                  **kw) -> DataFrame:
    """Keys -> match -> keep labelled flows -> tag with the dataset name."""
    m = match_flows(flows, labels, tolerance_ms, **kw)
    return tag_dataset(m.where(F.col("label").isNotNull()), dataset_name)


def build_and_save(flows: DataFrame, labels: DataFrame, dataset_name: str, tolerance_ms: int, root: str,
                   **kw) -> DataFrame:
    """J7 as a run: save the labelled flows under ``root`` (one partition per dataset) and report
    the match rate per pass. The matched flows are written once and read for both."""
    matched = materialize(match_flows(flows, labels, tolerance_ms, **kw), "matched")
    save_parquet(tag_dataset(matched.where(F.col("label").isNotNull()), dataset_name), root,
                 partition_by=["dataset_name"])
    return match_rate(matched)


def dataset_pipeline(flows: DataFrame, labels: DataFrame, dataset_name: str, tolerance_ms: int,
                     *, out_root: str | None = None, **kw) -> DataFrame:
    """All scenarios in one plan, written per (dataset, scenario), merged back."""
    built = build_dataset(flows, labels, dataset_name, tolerance_ms, scope=["scenario"], **kw)
    root = out_root or f"{shared_dir(flows.sparkSession)}/processed-{uuid.uuid4().hex}"
    save_parquet(built, root, partition_by=["dataset_name", "scenario"])
    # read back with the built schema: an empty result is an empty table, not an error
    return flows.sparkSession.read.schema(built.schema).parquet(root)


def run_dataset(spark: SparkSession, catalog: dict, dataset_name: str, packet_schema, *,
                tolerance_ms: int = 60_000, idle_ms: int = 10_000, active_ms: int = 120_000,
                hour_offset: int = 3, out_root: str | None = None) -> DataFrame:
    """P2 from raw files: prepare labels (P1), meter captures (M1), match and save (J7), merge.

    The loop over the catalog's scenarios only builds plans (and reads label file headers);
    labels are cleaned per scenario, then all scenarios are metered and matched in one plan
    each, ``scenario`` being part of every key. Labels and flows are written once, as the
    matching reads them several times. Unreadable captures are skipped.
    """
    labels, packets = [], []
    for sc in catalog[dataset_name]:
        tag = F.lit(sc)
        labels.append(prepare_labels(spark, paths_of(catalog, dataset_name, sc, "labels"), hour_offset=hour_offset)
                      .withColumn("scenario", tag))
        packets.append(read_captures(spark, paths_of(catalog, dataset_name, sc, "captures"), packet_schema)
                       .withColumn("scenario", tag))

    def merged(frames):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    keyed = with_flow_keys(merged(labels)).select("scenario", "flow_key", "ts_ms", "label")
    flows = with_flow_keys(meter_flows(merged(packets), idle_ms, active_ms, scope=["scenario"]))
    return dataset_pipeline(materialize(flows, "flows"), materialize(keyed, "labels"), dataset_name, tolerance_ms,
                            out_root=out_root)
