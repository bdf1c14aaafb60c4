"""Bulk retrieval, validation and upkeep of note corpora as Spark jobs."""
