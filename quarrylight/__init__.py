"""A Spark-native engine for document retrieval, knowledge graphs and dependency data."""

__version__ = "0.1.0"
