"""Market-signal analytics as Spark jobs."""
