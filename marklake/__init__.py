"""Rubric-evaluation analytics on Spark."""
