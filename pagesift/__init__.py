"""Spark-native analysis of crawled sites and of text corpora."""
