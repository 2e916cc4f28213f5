"""Label and evaluation data as Spark DataFrame operators."""
