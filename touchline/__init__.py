"""Squad analytics as Spark DataFrame jobs."""
