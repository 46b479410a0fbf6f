"""Scalar functions as Spark expressions."""
