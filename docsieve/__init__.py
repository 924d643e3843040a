"""Document-classification analytics as Spark DataFrame operators."""
