"""Scalar functions: links, exponential families and special functions."""
