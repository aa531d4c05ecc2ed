"""docweave: a PySpark-native engine for document structure, chunking, retrieval and corpus preparation."""

__version__ = "0.1.0"
