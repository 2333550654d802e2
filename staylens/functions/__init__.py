"""Scalar and aggregate building blocks."""
