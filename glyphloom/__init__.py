"""A PySpark-native engine for synthetic text-recognition datasets."""

__version__ = "0.1.0"
