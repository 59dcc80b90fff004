"""Measurement tables of segmented objects, processed on Spark."""
