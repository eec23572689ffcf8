"""Column functions made of built-in Spark SQL functions."""
