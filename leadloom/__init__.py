"""Lead operations analytics on Spark."""
