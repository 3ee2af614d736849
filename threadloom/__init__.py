"""Spark-native analytics for e-mail and discussion corpora."""
