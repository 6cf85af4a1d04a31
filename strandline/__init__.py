"""strandline: a PySpark-native engine for structural-variant call sets and the data around them."""

__version__ = "0.1.0"
