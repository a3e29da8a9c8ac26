"""Compound climate-event analytics as Spark DataFrame jobs."""
