"""PySpark-native analytics: coverage and provenance joins, graphs, document rules and corpus operators."""

__version__ = "0.1.0"
