"""loomspark: a Spark-native workspace analytics engine."""

__version__ = "0.1.0"
