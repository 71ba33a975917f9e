"""sceneloom: a PySpark-native engine for preparing and checking text corpora."""

__version__ = "0.1.0"
