"""Column functions, all of them built on Spark's own expressions."""
