"""Assessment-results analytics as Spark DataFrame operators."""
