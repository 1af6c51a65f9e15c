"""Sequence, interval and robustness analytics expressed as Spark jobs."""
