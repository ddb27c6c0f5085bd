"""siftgrove: full-text search, corpus analytics and training-data preparation as lazy PySpark plans."""

__version__ = "0.1.0"
