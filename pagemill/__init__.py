"""Analysis of text-recognition results on Spark."""
