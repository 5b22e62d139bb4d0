"""Column functions: plain Spark expressions, no Python on the executors."""
