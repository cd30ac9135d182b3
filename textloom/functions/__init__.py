"""Column-level building blocks; all of them are native Spark expressions."""
