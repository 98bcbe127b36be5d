"""furrow: Spark-native analytics for paired field trials."""
