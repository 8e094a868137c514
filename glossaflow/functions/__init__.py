"""Scalar functions on text, as Spark columns wherever built-ins reach."""
