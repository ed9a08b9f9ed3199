"""evq: evidence queries over tables and text, planned by Spark."""
