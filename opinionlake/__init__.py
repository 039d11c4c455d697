"""Feedback analytics on Spark: DataFrame + spec -> DataFrame."""
