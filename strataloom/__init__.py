"""strataloom: a PySpark-native engine for understanding text and source-code corpora."""

__version__ = "0.1.0"
