"""Spark-native analytics for multi-camera object tracking."""
