"""Spark-native evaluation and sampling engine for labelled media corpora."""
