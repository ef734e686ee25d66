"""Spark-first analytics for key-value-store data: keys, traffic, snapshots, documents, placement."""
