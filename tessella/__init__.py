"""tessella: a PySpark-native engine for typed, weighted semantic graphs."""

__version__ = "0.1.0"
