"""Spark jobs that order cells along a progression and select the genes that drive it."""
