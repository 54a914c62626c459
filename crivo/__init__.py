"""Text criteria, rules and corpus preparation expressed as Spark DataFrame operations."""
