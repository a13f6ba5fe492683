"""Parquet and CSV sources and sinks."""
