"""A PySpark library for learning data: analytics, prerequisite graphs, vector search, documents and streams."""
