"""Sinks: the Parquet log table, appends with dedup and ids, retention."""
