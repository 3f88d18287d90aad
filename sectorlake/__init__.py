"""Spark-native processing of sector-addressed media containers, sampled signals and block images."""
