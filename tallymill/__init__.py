"""Batch analytics on Spark: log analytics, order scoring and k-means clustering."""
