"""lodeworks: a PySpark-native engine for provenance-tracked measurement data."""

__version__ = "0.1.0"
