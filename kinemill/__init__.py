"""Pose-annotation analytics on Spark DataFrames."""
