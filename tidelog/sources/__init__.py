"""Canonical views over tables, and the Parquet forms of logs and sorted tables."""
