"""Spark-native curation and evaluation engine for labelled segmentation data."""
