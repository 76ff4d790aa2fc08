"""Somatic-alteration analytics as Spark DataFrame jobs."""
