"""Privacy work on text and tables, written as Spark DataFrame operators."""
