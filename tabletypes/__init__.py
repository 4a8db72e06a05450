"""Column understanding for large collections of tables, written as Spark DataFrame jobs."""
