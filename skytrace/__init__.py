"""Skytrace: a PySpark-native analytics engine for GPS flight trajectories."""
