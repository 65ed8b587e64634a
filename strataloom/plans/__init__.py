"""Registered queries of the core, each with its DuckDB oracle where SQL can state it."""
