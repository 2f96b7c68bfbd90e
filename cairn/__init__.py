"""Structural analytics over source trees, written as Spark jobs."""
