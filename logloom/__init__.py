"""Log template analytics on Spark."""
