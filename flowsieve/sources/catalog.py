"""Dataset / scenario catalog (S8) as data, not as a driver-side loop.

A catalog maps dataset -> scenario -> {"labels": [paths], "captures": [paths]}.
``catalog_frame`` turns it into a small DataFrame so scenario is a column.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Scenario names of the labelled capture days.
SCENARIOS = ("friday", "monday", "thursday", "tuesday", "wednesday")


def catalog_frame(spark: SparkSession, catalog: dict) -> DataFrame:
    rows = [(ds, sc, kind, p)
            for ds, scs in catalog.items()
            for sc, kinds in scs.items()
            for kind, paths in kinds.items()
            for p in paths]
    return spark.createDataFrame(rows, "dataset_name string, scenario string, kind string, path string")


def paths_of(catalog: dict, dataset: str, scenario: str, kind: str) -> list[str]:
    return list(catalog[dataset][scenario][kind])
