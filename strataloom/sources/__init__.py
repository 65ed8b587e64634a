"""Readers: parquet tables of a data folder and trees of source files."""
