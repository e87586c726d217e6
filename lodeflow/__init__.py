"""lodeflow: a PySpark-native analytics engine for taint-flow, code and text corpora."""

__version__ = "0.1.0"
