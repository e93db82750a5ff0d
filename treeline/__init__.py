"""treeline: a Spark-native engine for corpora kept as ordered, addressed trees."""
