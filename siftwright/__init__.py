"""Spark-first evidence analytics: similarity search, filters, lineage, state and evaluation as DataFrame operators."""
