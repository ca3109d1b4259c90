"""Spark analytics for stacks of noisy frames of a hexagonal crystal."""
