"""Spark-native batch analytics for apartment advertisements."""
