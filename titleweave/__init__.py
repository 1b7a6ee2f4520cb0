"""titleweave: Spark-native fuzzy title matching over large tables."""

__version__ = "0.2.0"
