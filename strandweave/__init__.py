"""strandweave: a PySpark-native engine for sequences and the graphs they define."""

__version__ = "0.1.0"
