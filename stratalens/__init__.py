"""Spark-native analytics for source-code corpora and the operational records around them."""
