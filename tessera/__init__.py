"""Document and conversation analytics as Spark jobs."""
