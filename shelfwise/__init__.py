"""Catalog, review and library analytics as Spark DataFrame jobs."""
