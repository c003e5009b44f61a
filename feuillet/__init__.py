"""Document search and text analytics on Spark."""
