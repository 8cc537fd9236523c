"""Hierarchical hexagonal-grid analytics as DataFrame functions on Spark."""
