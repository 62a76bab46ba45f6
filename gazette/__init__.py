"""Event-catalog analytics on Spark."""
