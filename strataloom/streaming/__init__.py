"""Structured Streaming: incremental upkeep of an index."""
