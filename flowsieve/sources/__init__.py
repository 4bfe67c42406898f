"""Scans and sinks: label CSV files, parquet tables, scenario merges."""
