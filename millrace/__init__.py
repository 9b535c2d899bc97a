"""A PySpark-native engine for ledgers, text evaluation and corpus curation."""

__version__ = "0.1.0"
