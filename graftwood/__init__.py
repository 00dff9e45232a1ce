"""Find similar code across two source trees, as Spark DataFrame operations."""
