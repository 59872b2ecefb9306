"""Replica stewardship for large archives, as Spark DataFrame jobs."""
