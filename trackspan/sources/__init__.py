"""Readers: exported JSON pages and Parquet tables to logical tables."""
