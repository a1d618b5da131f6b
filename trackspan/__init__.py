"""Work-tracking analytics expressed as Spark DataFrame operators."""
