"""boardwright: a Spark-native engine for large pools of text listings."""

__version__ = "0.1.0"
SCHEMA_VERSION = 3
