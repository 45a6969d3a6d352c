"""Claim verification as Spark DataFrame jobs."""
