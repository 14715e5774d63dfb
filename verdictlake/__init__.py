"""Spark-native analytics over online-judge submission logs."""
