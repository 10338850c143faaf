"""Scalar and aggregate semantics as Spark columns."""
