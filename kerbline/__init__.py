"""Spark-native analytics for geo-located defect observations."""
