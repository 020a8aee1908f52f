"""Citation and page analytics on Spark."""
