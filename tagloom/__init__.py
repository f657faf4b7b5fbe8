"""Document-accessibility analytics as Spark DataFrame jobs."""
