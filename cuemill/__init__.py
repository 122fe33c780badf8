"""cuemill: Spark-native catalogue, timed-text and publishing analytics."""
