"""Chronological transaction analytics expressed as Spark DataFrame jobs."""
