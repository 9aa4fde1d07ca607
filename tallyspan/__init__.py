"""Spark-native reconciliation of two records of the same money movements."""
