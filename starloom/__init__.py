"""starloom: a Spark-native engine for scientific image collections."""

__version__ = "0.1.0"
