"""Spark-native privacy analytics: DataFrame operators that find, tokenise, redact and audit personal data."""

__version__ = "0.1.0"
