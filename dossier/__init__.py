"""Document-evidence analytics as Spark DataFrame, SQL and streaming operators."""
