"""Scalar functions, as Spark columns or numpy arrays."""
