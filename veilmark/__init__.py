"""Spark-first engine for finding, masking and auditing sensitive data in very large tables."""
