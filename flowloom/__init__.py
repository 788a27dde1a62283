"""Flow-feature analytics on Spark."""
